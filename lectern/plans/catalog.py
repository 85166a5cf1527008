"""All registered queries by name."""

from __future__ import annotations

from lectern.plans import contract_plans, document_plans, ranking_plans, rule_plans, run_plans, set_plans, source_plans, text_plans, validation_plans

PLANS = {**ranking_plans.PLANS, **text_plans.PLANS, **set_plans.PLANS, **document_plans.PLANS, **validation_plans.PLANS, **run_plans.PLANS, **source_plans.PLANS, **rule_plans.PLANS, **contract_plans.PLANS}
