"""Named queries over the driver tables, each with an oracle in plain SQL."""

from lossbook.plans import analysis_plans, assess_plans, book_plans, edit_plans, intake_plans, match_plans, notice_plans, provenance_plans, queue_plans, text_plans

PLANS = (queue_plans, match_plans, assess_plans, book_plans, text_plans, notice_plans, edit_plans, intake_plans, provenance_plans, analysis_plans)
