"""Errors with stable codes."""

from __future__ import annotations


class EngineError(Exception):
    """A request that the engine refuses; `code` names the reason."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


#: SQL error conditions by number.
SQL_ERRORS = {
    1: "statement outside the grammar or of an inadmissible shape",
    2: "number of parameters differs",
    3: "prepared plan is older than the catalog",
    4: "unknown column",
    5: "duplicate column",
    6: "value is not of the column's type or domain",
    7: "null in a column that is not nullable",
    8: "primary key predicate is incomplete, duplicated, null or wrongly ordered",
    9: "malformed stored row",
    10: "catalog object of another kind",
    11: "no access path for this predicate",
    12: "unique key exists already",
    13: "primary key columns can't be updated",
    14: "duplicate or malformed index range bound",
    15: "check constraint is false",
    16: "foreign key parent is missing or still referenced",
    17: "unknown relation",
    18: "join candidate ceiling exceeded",
    19: "scan candidate ceiling exceeded",
}


def sql_error(number: int, detail: str = "") -> EngineError:
    return EngineError(f"SQL{number:03d}", SQL_ERRORS[number] + (f": {detail}" if detail else ""))
