"""Whole answers put together from the operators."""

from devicelode.plans.harvest import harvest, harvest_new  # noqa: F401
from devicelode.plans.questions import analyze, categories, compare, compare_status, device_answers, recommend  # noqa: F401
from devicelode.plans.refreshing import plan_refresh, refresh  # noqa: F401
