"""Registered queries of the core operators and their oracle SQL."""

from tessella.plans import answer_plans, eval_plans, extension_plans, retrieval_plans, split_plans, survey_plans, text_plans  # noqa: F401
from tessella.plans.registry import ORACLES, QUERIES  # noqa: F401
