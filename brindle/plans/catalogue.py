"""All queries: importing the plan modules registers them."""

from . import event_plans, guard_plans, inbox_plans, outbox_plans, record_plans, scalar_plans  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
