"""Erasure along declared references between tables: what refers to erased rows is deleted or loses its reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """`child`.`column` names `parent`.`key`; when the parent's row goes, the child's row goes too (delete) or its column becomes null."""

    child: str
    column: str
    parent: str
    key: str
    rule: str = "delete"

    def __post_init__(self):
        if self.rule not in ("delete", "null"):
            raise ValueError(f"{self.rule} is neither delete nor null")


def _in_order(references: list[Reference], root: str) -> list[str]:
    """Tables that references lead to from the root, parents first."""
    reached, grown = {root}, True
    while grown:
        more = {r.child for r in references if r.parent in reached and r.rule == "delete"} - reached
        reached, grown = reached | more, bool(more)
    touched = reached | {r.child for r in references if r.parent in reached}
    out: list[str] = []
    while len(out) < len(touched):
        ready = sorted(t for t in touched - set(out) if all(r.parent in out or r.parent not in touched for r in references if r.child == t))
        if not ready:
            raise ValueError(f"references go round in circles among {sorted(touched - set(out))}")
        out += ready
    return out


def erase(tables: dict[str, DataFrame], references: list[Reference], root: str, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of `root` whose key columns are those of `gone`, and without, or no longer referring to, whatever
    refers to them, through any number of tables. Each table is passed once: a row is marked by joins with the distinct keys that its
    parents have lost. Null references refer to nothing; tables that nothing leads to come back as they are.
    """
    keys = gone.columns
    doomed, kept = {root: tables[root].join(gone.distinct(), keys, "left_semi")}, dict(tables)
    kept[root] = tables[root].join(gone.distinct(), keys, "left_anti")
    for name in _in_order(references, root):
        if name == root:
            continue
        df, columns, lost = tables[name], tables[name].columns, F.lit(False)
        own = [r for r in references if r.child == name and r.parent in doomed]
        for i, r in enumerate(own):
            parents = doomed[r.parent].select(F.col(r.key).alias(f"_gone_{i}")).where(f"_gone_{i} IS NOT NULL").distinct()
            df = df.join(parents, F.col(r.column) == F.col(f"_gone_{i}"), "left")
            if r.rule == "delete":
                lost = lost | F.col(f"_gone_{i}").isNotNull()
        marked = df.withColumn("_lost", lost)
        cleared = {r.column: F.when(F.col(f"_gone_{i}").isNull(), F.col(r.column)) for i, r in enumerate(own) if r.rule == "null"}
        kept[name] = marked.where("NOT _lost").withColumns(cleared).select(*columns)
        if any(r.rule == "delete" for r in own):
            doomed[name] = marked.where("_lost").select(*columns)
    return kept


#: What hangs on a user: consultations with their messages, attachments and logs go; documents stay, without their owner.
USER_DATA = [
    Reference("conversations", "user_id", "users", "user_id"),
    Reference("messages", "conv_id", "conversations", "conv_id"),
    Reference("attachments", "message_id", "messages", "message_id"),
    Reference("logs", "message_id", "messages", "message_id"),
    Reference("documents", "user_id", "users", "user_id", "null"),
]
