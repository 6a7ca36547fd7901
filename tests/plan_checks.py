"""Helpers of the tests; not in a conftest, whose name another folder may have too."""

MESSAGES = "array<struct<role:string,content:string>>"


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
