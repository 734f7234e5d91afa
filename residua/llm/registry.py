"""The queries of the subpackage, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12

MODULES = (op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12)


def queries() -> dict:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict:
    return {m.NAME: m.SQL for m in MODULES if getattr(m, "SQL", None)}
