"""Registered queries. Importing this package registers all of them."""

from graphloom.plans import eval_plans, graph_plans, job_plans, mixing_plans, more_plans, reward_plans, text_plans  # noqa: F401
