"""Fixed values of the state model."""

from itertools import product

# Allowed (old, new) pairs of each kind, and the pairs of flows that are ignored.
JOB = [("UNCLAIMED", "CLAIMED"), ("CLAIMED", "COMPLETE"), ("CLAIMED", "UNCLAIMED")]
FLOW = [
    ("PENDING", "RUNNING"), ("RUNNING", "SUCCESS"), ("RUNNING", "FAILURE"), ("RUNNING", "REVERTED"), ("RUNNING", "SUSPENDING"), ("RUNNING", "RESUMING"),
    ("SUCCESS", "RUNNING"), ("FAILURE", "RUNNING"), ("REVERTED", "PENDING"), ("SUCCESS", "PENDING"),
    ("SUSPENDING", "SUSPENDED"), ("SUSPENDING", "SUCCESS"), ("SUSPENDING", "FAILURE"), ("SUSPENDING", "REVERTED"), ("SUSPENDING", "RESUMING"),
    ("SUSPENDED", "RUNNING"), ("RESUMING", "SUSPENDED"),
]
TASK = [
    ("PENDING", "RUNNING"), ("PENDING", "IGNORE"), ("RUNNING", "SUCCESS"), ("RUNNING", "FAILURE"), ("FAILURE", "REVERTING"), ("SUCCESS", "REVERTING"),
    ("REVERTING", "REVERTED"), ("REVERTING", "REVERT_FAILURE"), ("REVERTED", "PENDING"), ("IGNORE", "PENDING"),
]
RETRY = TASK + [("SUCCESS", "RETRYING"), ("RETRYING", "RUNNING")]
REQUEST = [("WAITING", "PENDING"), ("WAITING", "FAILURE"), ("PENDING", "RUNNING"), ("PENDING", "FAILURE"), ("RUNNING", "FAILURE"), ("RUNNING", "SUCCESS")]
ALLOWED = {"job": JOB, "flow": FLOW, "task": TASK, "retry": RETRY, "request": REQUEST}
FLOW_IGNORED = sorted(set(product(["PENDING", "FAILURE", "SUCCESS", "SUSPENDED", "REVERTED"], ["SUSPENDING", "SUSPENDED", "RESUMING"])) - {("SUSPENDED", "SUSPENDED")})
PRIORITIES = ["VERY_LOW", "LOW", "NORMAL", "HIGH", "VERY_HIGH"]
STARTS, FINISHES = ["RUNNING", "REVERTING"], ["SUCCESS", "FAILURE", "REVERTED", "REVERT_FAILURE"]
