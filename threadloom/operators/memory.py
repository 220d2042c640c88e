"""Memory candidates: statements of users that a rule finds and a reviewer accepts, edits or rejects."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import collapse_space, validity
from threadloom.operators.snapshots import insert_if_absent

#: The patterns of the kinds, in the order in which they are tried; the first that matches names the kind.
RULES = (
    ("boundary", r"(?:请|以后|回答时)?.{0,6}(?:不要|别再|不需要)|\b(?:do not|don't|never)\b"),
    ("preference", r"(?:我|本人).{0,12}(?:喜欢|偏好|习惯|希望|倾向|不喜欢|讨厌)|\bI (?:prefer|like|want)\b"),
    ("identity", r"(?:我是|我叫|我的职业|我的专业|我目前是)|\bI am\b|\bmy (?:name|job|major) is\b"),
    ("plan", r"(?:我|本人).{0,8}(?:打算|计划|正在|准备|想要)|\bI (?:plan|intend|am working|want to)\b"),
)
#: Fixed value: words that negate a statement.
NEGATION = r"(?:不要|不喜欢|不需要|不希望|别再|讨厌|\bnot\b|\bnever\b|don't)"
#: Letters of every script count as such at word boundaries and for case.
ANY_SCRIPT = "(?iuU)"
LEAST_LENGTH = 8
STATUSES = ("pending", "confirmed", "rejected", "outdated")


def classify(text: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(RULES):
        kind = F.when(F.rlike(text, F.lit(ANY_SCRIPT + pattern)), name).otherwise(kind)
    return kind


def candidate_id(*parts: Column) -> Column:
    return F.concat(F.lit("memc_"), F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 32))


def scan_candidates(messages: DataFrame, *, message: str, text_col: str, role_col: str, version: str | None = None, existing: DataFrame | None = None) -> DataFrame:
    """candidate_id, message, kind, statement of all user messages that a rule matches; with existing, only new ones."""
    statement = collapse_space(F.col(text_col))
    found = messages.where((F.col(role_col) == "user") & (F.length(statement) >= LEAST_LENGTH)).withColumn("kind", classify(statement)).where(F.col("kind").isNotNull())
    hashed = F.col(version) if version else F.sha2(F.col(text_col), 256)
    out = found.select(candidate_id(F.col(message).cast("string"), hashed, F.col("kind")).alias("candidate_id"), message, "kind", statement.alias("statement"))
    return out if existing is None else insert_if_absent(existing, out, ["candidate_id"])


def decide(decisions: DataFrame, ids: list[str], status: str, at: str, note: str | None = None) -> DataFrame:
    """The append-only decisions with one more for each id."""
    if status not in STATUSES or not 1 <= len(ids) <= 1000:
        raise ValueError("an unknown status, or not 1 to 1000 candidates")
    ids = list(dict.fromkeys(ids))
    rows = decisions.sparkSession.createDataFrame([(i, status, note, at) for i in ids], "candidate_id string, status string, note string, decided_at string")
    return decisions.unionByName(rows)


def review_state(candidates: DataFrame, decisions: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """candidates with the status of their last decision (pending without one) and the last wording."""
    last = decisions.groupBy("candidate_id").agg(F.max_by("status", "decided_at").alias("status"))
    out = candidates.join(last, "candidate_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    if edits is not None:
        wording = edits.groupBy("candidate_id").agg(F.max_by("statement", "edited_at").alias("reviewed"))
        out = out.join(wording, "candidate_id", "left").withColumn("original", F.col("statement")).withColumn("statement", F.coalesce("reviewed", "statement")).drop("reviewed")
    return out


def list_candidates(state: DataFrame, *, kinds: list[str] | None = None, statuses: list[str] | None = None, query: str | None = None, after: str | None = None, before: str | None = None, time_col: str = "created_at") -> DataFrame:
    """A filter for each setting that is given; times from after (included) to before (not)."""
    out = state
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    if statuses:
        out = out.where(F.col("status").isin(*statuses))
    if query:
        out = out.where(F.contains(F.lower("statement"), F.lit(query.lower())))
    if after:
        out = out.where(F.col(time_col) >= after)
    if before:
        out = out.where(F.col(time_col) < before)
    return out


def text_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """difflib's similarity ratio of two texts; 0 where its cheap upper bounds are below least."""

    @F.pandas_udf("double")
    def ratio(x: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for one, two in x:
            out = []
            for s, t in zip(one, two, strict=True):
                m = difflib.SequenceMatcher(None, s or "", t or "")
                out.append(m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0)
            yield pd.Series(out, dtype="float64")

    return ratio(a, b)


def casefold(text: Column) -> Column:
    """Lower case with the sharp s as ss, as full case folding has it; other folds of that kind are left."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def related(candidates: DataFrame, targets: DataFrame, *, thread: str | None = None, top: int = 8) -> DataFrame:
    """target_id, candidate_id, relation, score: the best `top` of the same kind for each target.

    Equal statements are duplicates (1.0); one that differs in negation, with a ratio of 0.52 or more without the negating
    words, is a possible conflict (0.2 more); others are related from a ratio of 0.58 on, or from 0.42 in one thread (0.08
    more). Scores end at 1.0. targets are what a reviewer looks at; pairs whose lengths rule out a ratio of 0.42 are never
    made into rows."""
    fold = lambda c: collapse_space(casefold(c))
    bare = lambda c: F.regexp_replace(c, ANY_SCRIPT + NEGATION, "")
    negative = lambda c: F.rlike(c, F.lit(ANY_SCRIPT + NEGATION))
    near = lambda a, b: F.least(F.length(a), F.length(b)) * 2.0 >= 0.42 * (F.length(a) + F.length(b))
    sides = []
    for rows, name in ((targets, "t"), (candidates, "c")):
        text = fold(F.col("statement"))
        sides.append(rows.select(F.col("candidate_id").alias(f"{name}_id"), "kind", text.alias(f"{name}_text"), bare(text).alias(f"{name}_bare"), negative(text).alias(f"{name}_negative"), (F.col(thread) if thread else F.lit(None).cast("string")).alias(f"{name}_thread")))
    pairs = sides[0].join(sides[1], "kind").where((F.col("t_id") != F.col("c_id")) & (near(F.col("t_text"), F.col("c_text")) | near(F.col("t_bare"), F.col("c_bare"))))
    pairs = pairs.withColumn("r", text_ratio(F.col("t_text"), F.col("c_text"), 0.42)).withColumn("core", text_ratio(F.col("t_bare"), F.col("c_bare"), 0.52))
    one = F.col("t_thread") == F.col("c_thread")
    opposed = (F.col("t_negative") != F.col("c_negative")) & (F.col("core") >= 0.52)
    relation = F.when(F.col("t_text") == F.col("c_text"), "duplicate").when(opposed, "possible_conflict").when((F.col("r") >= 0.58) | one & (F.col("r") >= 0.42), "related")
    score = F.when(F.col("relation") == "duplicate", 1.0).when(F.col("relation") == "possible_conflict", F.col("core") + 0.2).otherwise(F.col("r") + F.when(one, 0.08).otherwise(0.0))
    scored = pairs.withColumn("relation", relation).where(F.col("relation").isNotNull()).withColumn("score", score)
    order = Window.partitionBy("t_id").orderBy(F.desc("score"), "c_id")
    best = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top)
    return best.select(F.col("t_id").alias("target_id"), F.col("c_id").alias("candidate_id"), "relation", F.round(F.least("score", F.lit(1.0)), 3).alias("score"))


_BREAK = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85\u2028\u2029]"
_STRIP = r"(?U)^\s+|\s+$"


def explicit_statements(messages: DataFrame, *, text_col: str = "text") -> DataFrame:
    """messages with kind and statement: sentences in the first person singular of which a rule names the kind, 6 to 300
    characters long, without a question mark, on lines outside code fences that don't open with a quotation mark."""
    lines = F.split(F.concat(F.lit("\n"), F.col(text_col), F.lit("\n")), _BREAK)
    one = F.array_join(lines, "\n")
    outside = F.regexp_replace(one, r"(?sU)\n[^\S\n]*```[^\n]*(?=\n).*?(\n[^\S\n]*```[^\n]*(?=\n)|\z)", "\n")
    own = F.filter(F.split(outside, "\n"), lambda x: ~F.rlike(x, F.lit(r'(?U)^\s*[>“"]')))
    parts = F.transform(F.flatten(F.transform(own, lambda x: F.split(x, r"(?<=[。！？.!?])"))), lambda x: F.regexp_replace(x, _STRIP, ""))
    ok = lambda x: F.length(x).between(6, 300) & ~F.rlike(x, F.lit("[?？]")) & F.rlike(x, F.lit(r"(?iU)^(?:我|本人|I\s)"))
    out = messages.withColumn("statement", F.explode(F.filter(parts, ok)))
    return out.withColumn("kind", classify(F.col("statement"))).where(F.col("kind").isNotNull())


def consolidate(statements: DataFrame, *, kind: str, text_col: str, source: str, time_col: str | None = None, keep_sources: int = 3) -> DataFrame:
    """kind, norm, statement, n_sources, sources, newest: equal statements of one kind as a group, newest first.

    statement is the newest wording; sources are the newest `keep_sources` messages, newest first. Only these leave each
    partition before the shuffle; counts are summed beside them."""
    at = F.coalesce(F.col(time_col).cast("double"), F.lit(0.0)) if time_col else F.lit(0.0)
    rows = statements.select(F.col(kind).alias("kind"), collapse_space(casefold(F.col(text_col))).alias("norm"), F.col(text_col).alias("statement"), F.col(source).alias("source"), at.alias("at"))
    counts = rows.groupBy("kind", "norm").agg(F.count("*").alias("n_sources"))
    order = Window.partitionBy("kind", "norm").orderBy(F.desc("at"), "source", "statement")
    newest = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep_sources)
    found = newest.groupBy("kind", "norm").agg(F.array_sort(F.collect_list(F.struct("n", "source", "statement", "at"))).alias("s"))
    out = found.join(counts, ["kind", "norm"]).select("kind", "norm", F.col("s")[0]["statement"].alias("statement"), "n_sources", F.transform("s", lambda x: x["source"]).alias("sources"), F.col("s")[0]["at"].alias("newest"))
    return out.orderBy(F.desc("newest"), F.col("sources")[0], "kind", "norm")


def remember(assertions: DataFrame, messages: DataFrame, message_id: str, quote: str, at: str, kind: str = "statement", *, message: str = "message_id", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """The assertions (message_id, quote, kind, created_at) with one more, once: an exact quote of a visible user message."""
    if kind not in ("statement", "preference", "plan", "event"):
        raise ValueError("kind must be statement, preference, plan or event")
    found = messages.where((F.col(message) == message_id) & (F.col(role_col) == "user") & F.contains(F.col(text_col), F.lit(quote)))
    if not quote.strip() or found.isEmpty():
        raise ValueError("memory requires an exact quote from a visible user message")
    new = assertions.sparkSession.createDataFrame([(message_id, quote, kind, at)], "message_id string, quote string, kind string, created_at string")
    return assertions.unionByName(insert_if_absent(assertions, new, ["message_id", "quote"]))


def profile(confirmed: DataFrame, assertions: DataFrame, messages: DataFrame, feedback: DataFrame, *, as_of: str | None = None) -> DataFrame:
    """message_id, statement, kind, status, state: confirmed candidates and remembered quotes of visible messages, each
    message and wording once, confirmed ones first. state is current, or historical where the last feedback on the message
    says more than `restored`; excluded messages are left out. With a day as_of, historical ones get temporal_status, where the
    feedback's valid_from and valid_until (ISO days) put them on that day; others are historical_unverified."""
    one = confirmed.select("message_id", "statement", "kind", F.lit("confirmed").alias("status"), F.lit(0).alias("rank"))
    two = assertions.select("message_id", F.col("quote").alias("statement"), "kind", F.lit("user_requested").alias("status"), F.lit(1).alias("rank"))
    order = Window.partitionBy("message_id", "statement").orderBy("rank", "kind")
    rows = one.unionByName(two).withColumn("n", F.row_number().over(order)).where("n = 1").join(messages.select("message_id").distinct(), "message_id", "left_semi")
    dated = [c if c in feedback.columns else F.lit(None).cast("string").alias(c) for c in ("valid_from", "valid_until")]
    last = feedback.select("message_id", "id", "action", *dated).groupBy("message_id").agg(F.max_by(F.struct("action", "valid_from", "valid_until"), "id").alias("f")).select("message_id", "f.*")
    rows = rows.join(last, "message_id", "left").where("action IS NULL OR action <> 'excluded'")
    said = F.coalesce(F.col("action") != "restored", F.lit(False))
    stands = [validity(F.when(said, F.col("valid_from")), F.when(said, F.col("valid_until")), as_of, said & (F.col("action") == "outdated")).alias("temporal_status")] if as_of else []
    return rows.select("message_id", "statement", "kind", "status", F.when(said, "historical").otherwise("current").alias("state"), *stands)


#: What a user says of a message that takes it out of the profile.
NOT_OWN = ("excluded", "quoted", "corrected")


def observed_profile(messages: DataFrame, feedback: DataFrame, *, message: str = "message_id", text_col: str = "text", time_col: str = "create_time", keep_sources: int = 3) -> DataFrame:
    """kind, norm, statement, n_sources, sources (message, action), newest: what users said of themselves, equal statements as one
    group, from messages of which the last feedback (message, entry, action) isn't one of NOT_OWN; any other word but restored
    is told beside the source. greedy_budget takes from these groups, newest first, what a profile has room for."""
    last = feedback.groupBy(message).agg(F.max_by("action", "entry").alias("action")).where("action <> 'restored'")
    own = messages.join(last, message, "left").where(F.col("action").isNull() | ~F.col("action").isin(*NOT_OWN))
    said = explicit_statements(own, text_col=text_col).withColumn("source", F.struct(F.col(message).alias("message"), F.col("action")))
    return consolidate(said, kind="kind", text_col="statement", source="source", time_col=time_col, keep_sources=keep_sources)


def greedy_budget(groups: DataFrame, text_col: str, budget_chars: int = 6000, most: int = 30) -> list[dict]:
    """Rows in their order whose texts fit the budget; one that is too long is passed over. The choice is sequential: rows
    that fit the whole budget reach the driver one partition at a time, until the budget or `most` is spent."""
    out: list[dict] = []
    left = budget_chars
    if most <= 0:
        return out
    for row in groups.where(F.length(text_col) <= budget_chars).toLocalIterator():
        if len(row[text_col]) <= left:
            out.append(row.asDict())
            left -= len(row[text_col])
            if len(out) == most or left <= 0:
                break
    return out


def source_context(candidates: DataFrame, branch: DataFrame, *, thread: str, message: str, depth: str = "depth", around: int = 2) -> DataFrame:
    """candidate_id, the columns of branch, distance: the messages of a candidate's thread within `around` steps of its
    source on the branch. One equal join finds the source, the other its neighbours by depth; no thread is multiplied."""
    at = candidates.select("candidate_id", thread, message).join(branch.select(thread, message, F.col(depth).alias("at")), [thread, message])
    near = at.select("candidate_id", thread, F.explode(F.sequence(F.col("at") - around, F.col("at") + around)).alias(depth), "at")
    return near.join(branch.withColumn(depth, F.col(depth).cast("long")), [thread, depth]).withColumn("distance", F.col(depth) - F.col("at")).drop("at")
