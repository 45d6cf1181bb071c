"""Extraction from diffs, crash reports, mails, subjects and dates, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's strip takes away in ASCII.
SPACE = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f uses it: expressions inside lambdas share nothing by themselves."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


# Diffs


def fix_files(diff: Column) -> Column:
    """Paths of a diff in order, repeats kept."""
    return F.regexp_extract_all(diff, F.lit(r"diff --git a/(\S+)"), F.lit(1))


def additions(diff: Column) -> Column:
    """A bare + counts, as the character after it may be the line's end; ++ doesn't."""
    return F.regexp_count(diff, F.lit(r"(?md)^\+[^+]"))


def deletions(diff: Column) -> Column:
    return F.regexp_count(diff, F.lit(r"(?md)^-[^-]"))


def patch_size(diff: Column) -> Column:
    return additions(diff) + deletions(diff)


def diff_stats(diff: Column) -> Column:
    """files, additions, deletions, total_lines (null for an empty diff), hunks."""
    empty = (diff == "") | diff.isNull()
    return F.struct(
        F.when(empty, F.array().cast("array<string>")).otherwise(fix_files(diff)).alias("files"), F.coalesce(additions(diff), F.lit(0)).alias("additions"), F.coalesce(deletions(diff), F.lit(0)).alias("deletions"),
        F.when(~empty, patch_size(diff)).alias("total_lines"), F.coalesce(F.regexp_count(diff, F.lit("(?md)^@@")), F.lit(0)).alias("hunks"),
    )


def file_chunks(diff: Column) -> Column:
    """path and text of each file's part, in order."""
    parts = F.filter(F.split(diff, r"(?md)^(?=diff --git a/)"), lambda c: c.startswith("diff --git a/"))
    return F.transform(parts, lambda c: F.struct(F.regexp_extract(c, r"diff --git a/(\S+)", 1).alias("path"), c.alias("chunk")))


def lines_per_file(diff: Column) -> Column:
    """path and number of + and - lines, headers aside; a mail's closing "-- " counts for the last file."""
    changed = lambda c: F.size(F.filter(lines(c), lambda x: (x.startswith("+") | x.startswith("-")) & ~x.startswith("+++") & ~x.startswith("---")))
    return F.transform(file_chunks(diff), lambda x: F.struct(x["path"].alias("path"), changed(x["chunk"]).alias("lines")))


def changed_lines(diff: Column, sign: str) -> Column:
    """Added (+) or removed (-) lines without their sign."""
    return F.transform(F.filter(lines(diff), lambda x: x.startswith(sign) & ~x.startswith(sign * 3)), lambda x: F.substring(x, 2, 1 << 30))


def hunk_functions(diff: Column) -> Column:
    """First words after hunk headers; the space between may hold a line end."""
    return F.regexp_extract_all(diff, F.lit(r"(?md)^@@.*@@\s+(\w+)"), F.lit(1))


def touched_functions(diff: Column) -> Column:
    """First words after hunk headers on their line, and names of what look like function definitions in hunks."""
    headers = F.regexp_extract_all(diff, F.lit(r"(?md)^@@[^@]*@@[ \t]*(\w+)"), F.lit(1))
    body = F.filter(lines(diff), lambda x: x.rlike(r"^[+\- ]") & ~x.startswith("+++") & ~x.startswith("---"))
    heads = F.transform(body, lambda x: F.regexp_extract(x, r"^[+\- ]\s*[\w\s*]{1,80}?\s+\*?(\w+)\s*\([^;]*\)\s*$", 1))
    return F.array_distinct(F.array_union(headers, F.filter(heads, lambda x: x != "")))


def inline_diff(body: Column) -> Column:
    """From the first line that begins a diff to the first line after it that is --; empty if there is none."""
    all_ = lines(body)
    start = F.coalesce(F.array_position(F.transform(all_, lambda x: x.startswith("diff --git ")), True), F.lit(0))
    tail = F.slice(all_, F.greatest(start, F.lit(1)).cast("int"), F.size(all_))
    end = F.array_position(F.transform(tail, strip), "--")
    return F.when(start > 0, F.array_join(F.slice(tail, F.lit(1), F.when(end > 0, end).otherwise(F.size(tail)).cast("int")), "\n")).otherwise("")


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def top_dir(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


# Crash reports


#: Forms of a frame's line, inlined and plain.
INLINE_FRAME = r"(\w+)\s+(\S+\.(?:c|h|S)):(\d+)\s+\[inline\]"
PLAIN_FRAME = r"(\w+)\+0x[0-9a-f]+/0x[0-9a-f]+(?:\s+(\S+\.(?:c|h|S)):(\d+))?"


def stack_frames(report: Column) -> Column:
    """function, file ('' unknown), line (0 unknown), is_inline of each frame, first of equal (function, file, line) kept, order kept."""
    inline, plain = INLINE_FRAME, PLAIN_FRAME

    def frame(line: Column, pattern: str, inlined: bool) -> Column:
        number = F.coalesce(F.regexp_extract(line, pattern, 3).try_cast("int"), F.lit(0))
        return F.struct(F.regexp_extract(line, pattern, 1).alias("function"), F.regexp_extract(line, pattern, 2).alias("file"), number.alias("line"), F.lit(inlined).alias("is_inline"))

    found = F.transform(lines(report), lambda x: F.when(x.rlike(inline), frame(x, inline, True)).when(x.rlike(plain), frame(x, plain, False)))
    kept = F.filter(found, lambda x: x.isNotNull())
    kind = "array<struct<function:string,file:string,line:int,is_inline:boolean>>"
    same = lambda a, b: (a["function"] == b["function"]) & (a["file"] == b["file"]) & (a["line"] == b["line"])
    return F.when(report.isNull(), F.array().cast(kind)).otherwise(F.aggregate(kept, F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda y: same(x, y)), acc).otherwise(F.concat(acc, F.array(x)))))


# Mails


def own_text(body: Column) -> Column:
    """Without quoted lines; the signature stays."""
    return strip(F.array_join(F.filter(lines(body), lambda x: ~x.startswith(">")), "\n"))


def review_text(body: Column) -> Column:
    """Without quoted lines, up to a line that is --."""
    all_ = lines(body)
    end = F.array_position(F.transform(all_, strip), "--")
    head = F.when(end > 0, F.slice(all_, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(all_)
    return strip(F.array_join(F.filter(head, lambda x: ~x.startswith(">")), "\n"))


def filled_lines(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: strip(x) != ""))


#: Senders that are machines, mails of the stable review cycle, tags that say nothing by themselves.
BOTS = [r"syzbot", r"patchwork-bot", r"kernel test robot", r"lkp@intel\.com", r"tip-bot2", r"noreply", r"bot@"]
STABLE_SENDER, STABLE_MAIL = "sashal@kernel.org", r"This is an automated email"
STABLE_REVIEW = [r"stable review cycle", r"review patch.*queued.*stable"]
TAG_ONLY = r"Reviewed-by|Acked-by|Tested-by|LGTM|Applied|Thanks"


def is_bot(sender: Column, body: Column) -> Column:
    return sender.rlike("(?id)" + "|".join(BOTS)) | (sender.contains(STABLE_SENDER) & F.left(body, F.lit(300)).rlike(f"(?id){STABLE_MAIL}"))


def is_stable_review(body: Column) -> Column:
    return F.left(body, F.lit(500)).rlike("(?id)" + "|".join(STABLE_REVIEW))


def is_tag_only(body: Column) -> Column:
    text = own_text(body)
    return (F.length(text) <= 300) & (filled_lines(text) <= 3) & text.rlike(f"(?id){TAG_ONLY}")


def is_submission(subject: Column) -> Column:
    return subject.rlike(r"(?i)\[PATCH") & ~F.lower(strip(subject)).startswith("re:")


def is_human_review(sender: Column, subject: Column, body: Column) -> Column:
    return ~is_bot(sender, body) & ~is_stable_review(body) & ~is_submission(subject) & ~is_tag_only(body) & (filled_lines(own_text(body)) >= 2)


def is_backport_thread(subject: Column, version: Column, messages: Column) -> Column:
    named = subject.rlike(r"\[PATCH\s+\d+\.\d+\s+\d+/\d+\]") | subject.contains("AUTOSEL") | subject.rlike(r"(?i)\d+\.\d+[\.\d]*-rc\d+\s+review")
    return named | (F.coalesce(version == 1, F.lit(False)) & (F.size(messages) >= 50))


def sender_name(sender: Column) -> Column:
    return F.coalesce(F.nullif(strip(F.regexp_extract(sender, r"^([^<]+)<", 1)), F.lit("")), sender)


def sender_email(sender: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(sender, r"<([^>]+)>", 1), F.lit("")), sender)


#: Where subjects of each source have their version, and how backports name release lines.
SUBJECT_VERSION = {"list": r"(?i)\[PATCH[^\]]*\s+v(\d+)", "tracker": r"(?i)\[PATCH\s+v(\d+)", "patchwork": r"(?i)\[.*v(\d+)"}
STABLE_SERIES, STABLE_CYCLE, STABLE_AUTO = r"\[PATCH\s+(\d+\.\d+)\s+\d+/\d+\]", r"(?i)(\d+\.\d+)\.\d+-rc\d+\s+review", r"(\d+\.\d+)"


def subject_version(subject: Column, source: str) -> Column:
    """Patch version by the rule of its source: 'list' mails, the 'tracker' interface, or 'patchwork'; null if it is no patch."""
    found = F.regexp_extract(subject, SUBJECT_VERSION[source], 1).try_cast("int")
    if source == "tracker":
        return found
    return F.coalesce(found, F.when(subject.rlike(r"(?i)\[PATCH\b") if source == "list" else subject.contains("[PATCH"), F.lit(1)))


def stable_versions(subject: Column) -> Column:
    """Release lines that a backport thread's subject names; AUTOSEL's only from 3 on."""
    series = F.nullif(F.regexp_extract(subject, STABLE_SERIES, 1), F.lit(""))
    cycle = F.nullif(F.regexp_extract(subject, STABLE_CYCLE, 1), F.lit(""))
    auto = F.nullif(F.regexp_extract(subject, STABLE_AUTO, 1), F.lit(""))
    auto = F.when(subject.contains("AUTOSEL") & (F.substring_index(auto, ".", 1).try_cast("int") >= 3), auto)
    return F.array_distinct(F.array_compact(F.array(series, cycle, auto)))


# Dates


def iso_instant(text: Column) -> Column:
    """A date, or date and time with or without zone; none means UTC. Null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(F.regexp_replace(text, r"\s+([+-])", "$1")))


#: Zones of old mails by name.
OBSOLETE_ZONES = {"GMT|UT|UTC|Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def mail_instant(text: Column) -> Column:
    """RFC 2822 with or without weekday, trailing comment or zone; else as iso_instant."""
    return bound(F.regexp_replace(F.regexp_replace(strip(text), r"^\w{3},\s*", ""), r"\s*\([^)]*\)\s*$", ""), lambda plain: bound(_numeric_zone(plain), _mail_instant))


def _numeric_zone(plain: Column) -> Column:
    named = plain
    for zone, offset in OBSOLETE_ZONES.items():
        named = F.regexp_replace(named, rf"\s(?:{zone})$", f" {offset}")
    return F.when(plain.rlike(r"\s[A-Z]{1,3}$"), named).otherwise(plain)


def _mail_instant(plain: Column) -> Column:
    zoned = F.when(plain.rlike(r"^\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")))
    naive = F.when(plain.rlike(r"^\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(F.concat(plain, F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z")))
    return F.coalesce(zoned, naive, iso_instant(plain))


def wall_clock(text: Column) -> Column:
    """What the clock of a mail's header read, its zone left aside, as an instant of UTC; null for other forms."""
    plain = F.regexp_replace(strip(text), r"\s*\([^)]*\)\s*$", "")
    mail = lambda x: F.regexp_extract(x, r"^(?:\w{3},\s+)?(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})(?: ?(?:[+-]\d{2}:?\d{2}|Z))?$", 1)
    iso = lambda x: F.regexp_extract(x, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})(?: ?(?:[+-]\d{2}:?\d{2}|Z))?$", 1)
    of_mail = lambda x: F.when(x != "", F.try_to_timestamp(F.concat(x, F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z")))
    of_iso = lambda x: F.when(x != "", F.try_to_timestamp(F.concat(x, F.lit("+00:00"))))
    return bound(plain, lambda x: F.coalesce(bound(mail(x), of_mail), bound(iso(x), of_iso)))


def iso_wall(text: Column) -> Column:
    """What an ISO date, or date and time, reads with its zone left aside, as an instant of UTC; null for other forms."""
    found = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?(?:Z|[+-]\d{2}:?\d{2})?$", 1)
    time = F.coalesce(F.nullif(F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)", 1), F.lit("")), F.lit("00:00:00"))
    return F.when(found != "", F.try_to_timestamp(F.concat(found, F.lit("T"), time, F.lit("+00:00"))))


def days_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(86_400e6)


# Sets and tokens


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[a-zA-Z_][a-zA-Z0-9_]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def scope_change(before: Column, after: Column) -> Column:
    """expanded, narrowed, restructured or same, of two file sets."""
    more, less = F.size(F.array_except(after, before)) > 0, F.size(F.array_except(before, after)) > 0
    return F.when(more & ~less, "expanded").when(less & ~more, "narrowed").when(more & less, "restructured").otherwise("same")
