"""Vocabulary of the lifecycle store."""

# States in declaration order.
TASK_STATUSES = ["PENDING", "CLAIMED", "RUNNING", "COMPLETED", "FAILED", "CANCELLED", "EXPIRED"]
WORKFLOW_STATUSES = ["PENDING", "RUNNING", "COMPLETED", "FAILED", "PAUSED", "CANCELLED", "EXPIRED"]
NODE_STATUSES = ["PENDING", "READY", "ENQUEUED", "RUNNING", "COMPLETED", "FAILED", "SKIPPED"]
TASK_TERMINAL = ["COMPLETED", "FAILED", "CANCELLED", "EXPIRED"]
WORKFLOW_TERMINAL = ["COMPLETED", "FAILED", "CANCELLED", "EXPIRED"]
NODE_TERMINAL = ["COMPLETED", "FAILED", "SKIPPED"]

# Moves a task, a workflow and a node may make.
TASK_MOVES = {
    "PENDING": ["CLAIMED", "CANCELLED", "EXPIRED"], "CLAIMED": ["PENDING", "RUNNING", "CANCELLED", "EXPIRED", "FAILED"],
    "RUNNING": ["PENDING", "COMPLETED", "FAILED", "CANCELLED"],
}
WORKFLOW_MOVES = {"PENDING": ["RUNNING", "CANCELLED"], "RUNNING": ["COMPLETED", "FAILED", "PAUSED", "CANCELLED", "EXPIRED"], "PAUSED": ["RUNNING", "CANCELLED", "EXPIRED"]}
NODE_MOVES = {"PENDING": ["READY", "SKIPPED"], "READY": ["ENQUEUED", "SKIPPED"], "ENQUEUED": ["RUNNING", "COMPLETED", "FAILED", "SKIPPED"], "RUNNING": ["COMPLETED", "FAILED"]}

# Built-in error codes by family.
ERROR_FAMILIES = {
    "OPERATIONAL": ["UNHANDLED_ERROR", "TASK_ERROR", "WORKER_CRASHED", "BROKER_ERROR", "WORKER_RESOLUTION_ERROR", "WORKER_SERIALIZATION_ERROR", "RESULT_DESERIALIZATION_ERROR", "WORKFLOW_ENQUEUE_FAILED", "SUBWORKFLOW_LOAD_FAILED"],
    "CONTRACT": ["ARGUMENT_TYPE_MISMATCH", "RETURN_TYPE_MISMATCH", "WORKFLOW_CTX_MISSING_ID"],
    "RETRIEVAL": ["WAIT_TIMEOUT", "TASK_NOT_FOUND", "WORKFLOW_NOT_FOUND", "RESULT_NOT_AVAILABLE", "RESULT_NOT_READY"],
    "OUTCOME": ["TASK_CANCELLED", "TASK_EXPIRED", "TASK_TIMEOUT", "WORKFLOW_PAUSED", "WORKFLOW_FAILED", "WORKFLOW_CANCELLED", "WORKFLOW_EXPIRED", "UPSTREAM_SKIPPED", "SUBWORKFLOW_FAILED", "WORKFLOW_SUCCESS_CASE_NOT_MET", "WORKFLOW_STOPPED", "SEND_SUPPRESSED"],
}
BUILT_IN_CODES = [c for codes in ERROR_FAMILIES.values() for c in codes]

# Ways in which a task ends.
TERMINAL_KINDS = [
    "COMPLETE_LOCKED", "COMPLETE_FUSED", "FAIL_RUNNING", "FAIL_STALE", "EXPIRE_CLAIMED", "EXPIRE_PENDING", "CANCEL_ADMIN", "CANCEL_ORPHAN",
    "CANCEL_ORPHAN_SWEEP", "PAUSE_ABANDON_CLAIM", "PAUSE_ABANDON_CLAIM_BATCH", "PAUSE_ABANDON_WORKFLOW", "WORKFLOW_CANCEL_CLAIM",
    "WORKFLOW_CANCEL_CLAIM_BATCH", "WORKFLOW_CANCEL_WORKFLOW", "LEGACY_TERMINAL",
]
# The state in which each way ends, and the ways whose workflow part follows later.
STATUS_OF_KIND = {
    "COMPLETE_LOCKED": "COMPLETED", "COMPLETE_FUSED": "COMPLETED", "FAIL_RUNNING": "FAILED", "FAIL_STALE": "FAILED", "EXPIRE_CLAIMED": "EXPIRED",
    "EXPIRE_PENDING": "EXPIRED", "CANCEL_ADMIN": "CANCELLED", "CANCEL_ORPHAN": "CANCELLED", "CANCEL_ORPHAN_SWEEP": "CANCELLED", "PAUSE_ABANDON_CLAIM": "CANCELLED",
    "PAUSE_ABANDON_CLAIM_BATCH": "CANCELLED", "PAUSE_ABANDON_WORKFLOW": "CANCELLED", "WORKFLOW_CANCEL_CLAIM": "CANCELLED", "WORKFLOW_CANCEL_CLAIM_BATCH": "CANCELLED", "WORKFLOW_CANCEL_WORKFLOW": "CANCELLED",
}
# The way that may end in any terminal state.
ANY_STATUS_KIND = "LEGACY_TERMINAL"
DEFERRED_KINDS = ["COMPLETE_LOCKED", "FAIL_RUNNING", "FAIL_STALE", "EXPIRE_CLAIMED"]
MAX_QUEUE_PRIORITY = 100
