"""Row filters of the activity report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dbpulse.functions.scalars import like

FILTER_COLUMNS = {"session": "session_id", "program": "program_name",
                  "database": "database_name", "login": "login_name", "host": "host_name"}


def _session_all(pattern) -> bool:
    return pattern in (None, "", 0, "0")


def include_predicate(kind: str, pattern):
    """Session id equality ('' or 0 = everything) or a case-insensitive
    LIKE on the named attribute."""
    col = F.col(FILTER_COLUMNS[kind])
    if kind == "session":
        return F.lit(True) if _session_all(pattern) else (col == F.lit(int(pattern)))
    return F.lit(True) if pattern in (None, "") else like(col, pattern)


def exclude_predicate(kind: str, pattern):
    """The complement of P2. NULL attributes are kept (they do not match
    the pattern, so they are not excluded)."""
    col = F.col(FILTER_COLUMNS[kind])
    if kind == "session":
        return F.lit(True) if _session_all(pattern) else F.coalesce(col != F.lit(int(pattern)), F.lit(True))
    if pattern in (None, ""):
        return F.lit(True)
    return F.coalesce(~like(col, pattern), F.lit(True))


def session_filter(df: DataFrame, *, include: tuple[str, object] | None = None,
                   exclude: tuple[str, object] | None = None, own_session_id: int | None = None,
                   show_own: bool = False, show_system: bool = False, show_sleeping: int = 1,
                   forced: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """P2-P8 in one ``filter``.

    ``show_sleeping``: 0 none, 1 only with an open transaction, 2 all.
    System sessions that the list of sources names (``named``, J15) are shown.
    ``forced`` (P8) is a DataFrame of (keys, session_id) that bypass the
    filters — the blockers of collected sessions; it is applied through a
    left-semi join so nothing is collected.
    """
    cond = F.lit(True)
    if include:
        cond = cond & include_predicate(*include)
    if exclude:
        cond = cond & exclude_predicate(*exclude)
    if not show_own and own_session_id is not None:
        cond = cond & (F.col("session_id") != F.lit(own_session_id))
    if not show_system:
        own = F.col("is_user_process")
        cond = cond & (own | F.col("named") if "named" in df.columns else own)
    if show_sleeping == 0:
        cond = cond & (F.col("status") != "sleeping")
    elif show_sleeping == 1:
        cond = cond & ((F.col("status") != "sleeping") | (F.col("open_tran_count") > 0))
    if forced is None:
        return df.filter(cond)
    flagged = df.withColumn("_keep", cond)
    forced_keys = forced.select(*keys, "session_id").distinct().withColumn("_forced", F.lit(True))
    return (flagged.join(forced_keys, on=[*keys, "session_id"], how="left")
            .filter(F.col("_keep") | F.col("_forced").isNotNull())
            .drop("_keep", "_forced"))


def blockers_of(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sessions named as a blocker by some other row (keys, session_id)."""
    return (df.filter((F.col("blocked") != 0) & F.col("blocked").isNotNull())
            .select(*keys, F.col("blocked").alias("session_id")).distinct())
