"""Scalar helpers as native Column expressions.

Nothing here is a Python UDF: every function builds a Catalyst expression
that runs inside whole-stage codegen. String positions follow SQL (1-based).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dbpulse.functions.numeric import idiv

# ------------------------------------------------------------------ C1 / C42


def kv_extract(text: Column, marker: str, delimiter: str = " ") -> Column:
    """The value after ``marker`` up to ``delimiter`` or the end.

    Absent marker or empty value gives NULL.
    """
    pos = F.locate(marker, text)
    rest = F.substr(text, pos + F.lit(len(marker)))
    val = F.substring_index(rest, delimiter, 1)
    return F.when(pos > 0, F.nullif(val, F.lit("")))


def kv_extract_long(text: Column, marker: str, delimiter: str = " ") -> Column:
    """C1 with the value parsed as an id (bad text -> NULL, never an error)."""
    return kv_extract(text, marker, delimiter).try_cast("bigint")


def first_word(text: Column) -> Column:
    """Text before the first space (whole text when there is none)."""
    return F.substring_index(text, " ", 1)


# Fixed values in block_info: the lock types and the markers of their ids in a resource text.
def block_info(wait_type: Column, resource: Column, blocking_session_id: Column) -> Column:
    """Lock record parsed from a waiting task's resource string.

    Only lock waits (``LCK_*``) that name a blocker get a record; the fields
    that apply depend on the lock type (the first word of the resource).
    """
    lock_type = first_word(resource)
    hobt = (F.when(lock_type.isin("pagelock", "extentlock", "ridlock"),
                   kv_extract(resource, "associatedObjectId="))
             .when(lock_type.isin("keylock", "hobtlock", "allocunitlock"),
                   kv_extract(resource, "hobtid=")))
    rec = F.struct(
        lock_type.alias("lock_type"),
        kv_extract_long(resource, "dbid=").alias("database_id"),
        F.when(lock_type == "objectlock", kv_extract(resource, "objid=")).alias("object_id"),
        F.when(lock_type == "filelock", kv_extract(resource, "fileid=")).alias("file_id"),
        hobt.alias("hobt_id"),
        F.when(lock_type == "applicationlock", kv_extract(resource, "hash=")).alias("applock_hash"),
        F.when(lock_type == "metadatalock", kv_extract(resource, "subresource=")).alias("metadata_resource"),
        F.when(lock_type == "metadatalock", kv_extract(resource, "classid=", " dbid=")).alias("metadata_class_id"),
    )
    return F.when(blocking_session_id.isNotNull() & wait_type.startswith("LCK_"), rec)


# ----------------------------------------------------------------------- C2
_CONTROL = "[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]"


def scrub_control(text: Column, nul_to: str = "") -> Column:
    """Control characters 1-8, 11, 12, 14-31 become ``?``; NUL is removed
    (or replaced by ``nul_to``). Tab, LF and CR are kept."""
    return F.regexp_replace(F.regexp_replace(text, _CONTROL, "?"), "\\x00", nul_to)


# ----------------------------------------------------------------------- C3


# The allocation pages of a database file, as (class, number of its
# first page, pages from one to the next, number that a multiple is ahead of it).
PAGE_CLASSES = (("PFS", 1, 8088, 0), ("GAM", 2, 511232, 0), ("SGAM", 3, 511232, 1), ("DCM", 6, 511232, 6),
                ("BCM", 7, 511232, 7))


def page_type(page_no: Column) -> Column:
    """Allocation-page class of a page number; the first class that fits counts."""
    out = F.when(page_no.isNull(), F.lit(None).cast("string"))
    for name, first, step, ahead in PAGE_CLASSES:
        out = out.when((page_no == first) | ((page_no - ahead) % step == 0), name)
    return out.otherwise("*")


# ------------------------------------------------------------------- C4 / C6


def _page_latch_parts(resource: Column):
    db = F.substring_index(resource, ":", 1)
    page = F.substring_index(resource, ":", -1)
    middle = F.regexp_extract(resource, "^[^:]*:(.*):[^:]*$", 1)
    return db, middle, page


def wait_suffix(wait_type: Column, resource: Column, database_name: Column | None = None,
                with_oledb: bool = True) -> Column:
    """C4: decoration appended to a wait type.

    Page latches get ``:db:file(page class)``, parallel exchanges ``:node``,
    latches `` [class]``, and (single-wait path only) OLEDB waits on a linked
    session ``[provider:spid]``. ``database_name`` replaces the numeric id
    when the caller joined a database dimension; a missing name is
    ``(null)``.
    """
    db, middle, page = _page_latch_parts(resource)
    dbname = F.coalesce(database_name, F.lit("(null)")) if database_name is not None else db
    page_latch = F.concat(F.lit(":"), dbname, F.lit(":"), middle, F.lit("("),
                          page_type(page.try_cast("int")), F.lit(")"))
    node_pos = F.locate("nodeId", resource)
    cx = F.concat(F.lit(":"), F.substr(resource, node_pos + 7, F.lit(4)))
    latch = F.concat(F.lit(" ["), first_word(resource), F.lit("]"))
    spid_pos = F.locate("(SPID=", resource)
    spid = F.substring_index(F.substr(resource, spid_pos + 6), ")", 1)
    oledb = F.concat(F.lit("["), F.substr(resource, F.lit(1), spid_pos - 2), F.lit(":"), spid, F.lit("]"))
    out = (F.when(wait_type.rlike("^PAGE.*LATCH."), page_latch)
           .when(wait_type == "CXPACKET", cx)
           .when(wait_type.startswith("LATCH_"), latch))
    if with_oledb:
        out = out.when((wait_type == "OLEDB") & resource.rlike("\\(SPID=.*\\)$"), oledb)
    return out.otherwise(F.lit(""))


def single_wait_text(duration_ms: Column, wait_type: Column, resource: Column,
                     database_name: Column | None = None) -> Column:
    """``(Nms)type`` followed by the C4 suffix."""
    return F.concat(F.lit("("), duration_ms.cast("string"), F.lit("ms)"), wait_type,
                    wait_suffix(wait_type, resource, database_name))


# ----------------------------------------------------------------------- C5


def wait_text(n: Column, min_ms: Column, avg_ms: Column, max_ms: Column, wait_type: Column) -> Column:
    """``(nx: A[/B[/C]]ms)type``. One wait shows its time, two show
    min/max, three or more min/avg/max; equal bounds show the max only.
    A NULL count (no waits) gives NULL."""
    s = lambda c: c.cast("string")
    times = (F.when(n == 1, s(min_ms))
             .when(min_ms == max_ms, s(max_ms))
             .when(n == 2, F.concat(s(min_ms), F.lit("/"), s(max_ms)))
             .otherwise(F.concat(s(min_ms), F.lit("/"), s(avg_ms), F.lit("/"), s(max_ms))))
    return F.concat(F.lit("("), s(n), F.lit("x: "), times, F.lit("ms)"), wait_type)


# ------------------------------------------------------------------- C7 / C8


def elapsed_text(ms: Column, day_width: Column | int = 2) -> Column:
    """``dd hh:mm:ss.mss``; days zero-padded to ``day_width`` (>= 2).

    Milliseconds stay a long, so there is no 576-hour switch to seconds; a
    negative span (start after the collection time) gets a leading ``-``.
    """
    a = F.abs(ms)
    days = idiv(a, F.lit(86400000))
    rem = a % 86400000
    hh = idiv(rem, F.lit(3600000))
    mi = idiv(rem % 3600000, F.lit(60000))
    ss = idiv(rem % 60000, F.lit(1000))
    mss = rem % 1000
    width = day_width if isinstance(day_width, Column) else F.lit(day_width)
    # Never cut digits: a value wider than the requested width keeps them all.
    width = F.greatest(width, F.lit(2), F.length(days.cast("string")))
    pad2 = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(F.lpad(days.cast("string"), width, "0"), F.lit(" "), pad2(hh), F.lit(":"),
                    pad2(mi), F.lit(":"), pad2(ss), F.lit("."), F.lpad(mss.cast("string"), 3, "0"))
    return F.when(ms < 0, F.concat(F.lit("-"), text)).otherwise(text)


def day_width(ms: Column) -> Column:
    """Digits of the day part, at least 2 (use with a window for the max)."""
    return F.greatest(F.length(idiv(F.abs(ms), F.lit(86400000)).cast("string")), F.lit(2))


def count_text(n: Column) -> Column:
    """Thousands separators, no decimals, right-aligned in 19 chars (a
    longer text is never cut)."""
    return right_aligned(F.format_number(n, 0))


def right_aligned(text: Column, width: int = 19) -> Column:
    """``text`` with blanks before it up to ``width``; longer texts stay whole."""
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0))), text)


# ------------------------------------------------------------------ C9 / C17


def statement_slice(text: Column, start_offset: Column, end_offset: Column) -> Column:
    """The current statement of a batch.

    Offsets count bytes of two-byte text, so they are halved; an end of -1
    means the rest of the text. The whole text is returned when it is
    shorter than the end offset or when the cut would land between two
    alphanumerics; a zero start returns the whole text, trimmed.
    """
    half_start = idiv(start_offset, F.lit(2))
    text_len = F.length(F.rtrim(text))
    pair = F.when(half_start >= 1, F.substr(text, half_start, F.lit(2)))
    whole = ((text_len < idiv(end_offset, F.lit(2)) + 1)
             | F.coalesce(pair.rlike("^[a-zA-Z0-9]{2}$"), F.lit(False)))
    cut = F.when(end_offset == -1, F.substr(text, half_start + 1)) \
        .otherwise(F.substr(text, half_start + 1, idiv(end_offset - start_offset, F.lit(2)) + 1))
    return F.when(whole, text).when(start_offset > 0, cut).otherwise(F.trim(text))


def resource_type_text(rtype: Column, subtype: Column) -> Column:
    """C17: ``type.subtype``, just ``type`` when the subtype is empty."""
    return F.when(F.coalesce(subtype, F.lit("")) == "", rtype) \
        .otherwise(F.concat(rtype, F.lit("."), subtype))


# ----------------------------------------------------------------- C10-C12


# Fixed value: how the program name of an agent's job step begins.
AGENT_PREFIX = "SQLAgent - TSQL JobStep (Job 0x"


def agent_job_hex(program_name: Column) -> Column:
    """The 32 hex digits of a job id in an agent step's program name."""
    return F.when(program_name.startswith(AGENT_PREFIX),
                  F.nullif(F.regexp_extract(program_name, "\\(Job 0x([0-9A-Fa-f]{32}) : Step", 1), F.lit("")))


def agent_step_id(program_name: Column) -> Column:
    """The step number of an agent step's program name."""
    raw = F.regexp_extract(program_name, ": Step ([0-9]+)\\)", 1)
    return F.when(program_name.startswith(AGENT_PREFIX),
                  F.nullif(raw, F.lit("")).try_cast("int"))


def hex_to_guid(hex32: Column) -> Column:
    """C11: 32 hex digits -> GUID text, first three groups byte-swapped."""
    h = F.upper(hex32)
    b = lambda i: F.substr(h, F.lit(2 * i + 1), F.lit(2))
    return F.when(F.length(h) == 32, F.concat(
        b(3), b(2), b(1), b(0), F.lit("-"), b(5), b(4), F.lit("-"), b(7), b(6), F.lit("-"),
        F.substr(h, F.lit(17), F.lit(4)), F.lit("-"), F.substr(h, F.lit(21), F.lit(12))))


def handle_hex(handle: Column) -> Column:
    """Binary handle as ``0x`` + lowercase hex."""
    return F.concat(F.lit("0x"), F.lower(F.hex(handle)))


# ----------------------------------------------------------- C20-C22, C32


def elapsed_ms(start: Column, as_of: Column) -> Column:
    """C20: milliseconds from ``start`` to ``as_of`` (kept as a long)."""
    return F.timestamp_diff("MILLISECOND", start, as_of)


def round_to_second(t: Column) -> Column:
    """Nearest second, as ``timestamp_ntz`` (``date_trunc`` itself
    returns a zone-dependent TIMESTAMP; the cast keeps the wall clock)."""
    return F.date_trunc("second", t + F.expr("INTERVAL 500 MILLISECONDS")).cast("timestamp_ntz")


def round_to_minute(t: Column) -> Column:
    """Nearest minute (the small-datetime cast), as ``timestamp_ntz``."""
    return F.date_trunc("minute", t + F.expr("INTERVAL 30 SECONDS")).cast("timestamp_ntz")


def days_before(as_of: Column, days: int) -> Column:
    """``as_of`` minus ``days`` days."""
    return as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def temp_pages(alloc_user: Column, alloc_internal: Column, dealloc_user: Column,
               dealloc_internal: Column) -> tuple[Column, Column]:
    """(allocations, current) page counts."""
    allocs = alloc_user + alloc_internal
    return allocs, allocs - (dealloc_user + dealloc_internal)


# ----------------------------------------------------------------------- C14


def like_to_java_regex(pattern: str, escape: str | None = None) -> str:
    """SQL LIKE (``%``, ``_``, ``[set]``, ``[^set]``, optional escape char) as
    an anchored, case-insensitive Java regex."""
    import re
    out, i = ["(?is)^"], 0
    while i < len(pattern):
        ch = pattern[i]
        if escape and ch == escape and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
            continue
        if ch == "%":
            out.append(".*")
        elif ch == "_":
            out.append(".")
        elif ch == "[" and "]" in pattern[i + 1:]:
            j = pattern.index("]", i + 1)
            body = pattern[i + 1:j]
            neg = body.startswith("^")
            body = body[1:] if neg else body
            body = body.replace("\\", "\\\\")
            out.append(("[^" if neg else "[") + body + "]")
            i = j
        else:
            out.append(re.escape(ch))
        i += 1
    out.append("$")
    return "".join(out)


def like(col: Column, pattern: str, escape: str | None = None) -> Column:
    """C14: case-insensitive LIKE. There is no escape character unless one is
    given: a backslash stands for itself (domain logins hold one), a literal
    wildcard is written as a set, ``[_]``. Plain ``%``/``_`` patterns use
    ``ilike``; patterns with a ``[set]`` or an escape use an equivalent regex."""
    if "[" in pattern or escape is not None:
        return col.rlike(like_to_java_regex(pattern, escape))
    return col.ilike(pattern.replace("\\", "\\\\"))


# ----------------------------------------------------------------- P10/P11

# Isolation level codes and their labels.
ISOLATION_LEVELS = {0: "Unspecified", 1: "ReadUncomitted", 2: "ReadCommitted",
                    3: "Repeatable", 4: "Serializable", 5: "Snapshot"}


def isolation_level_text(code: Column) -> Column:
    out = None
    for k, v in ISOLATION_LEVELS.items():
        out = (F.when(code == k, v) if out is None else out.when(code == k, v))
    return out


def on_off(flag: Column) -> Column:
    """1 -> ON, 0 -> OFF."""
    return F.when(flag.cast("int") == 1, "ON").when(flag.cast("int") == 0, "OFF")
