"""No streaming operators: the work is batch evaluation, and its rolling windows are windows of origins, not of event time."""
