"""Evidence retrieval for agents: visible messages, keyword hits within a text budget, and context around a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import ascii_lower, clip, validity
from threadloom.operators.search import matches
from threadloom.operators.snapshots import latest_by

ROLES = ("user", "assistant")


def visible(role: Column, payload: Column | None = None) -> Column:
    """Messages of users and assistants that aren't hidden, on channel final and to all; missing settings pass."""
    ok = role.isin(*ROLES)
    if payload is None:
        return ok
    hidden = F.coalesce(F.get_json_object(payload, "$.metadata.is_visually_hidden_from_conversation"), F.lit("false"))
    channel = F.coalesce(F.get_json_object(payload, "$.channel"), F.lit("final"))
    recipient = F.coalesce(F.get_json_object(payload, "$.recipient"), F.lit("all"))
    return ok & (hidden != "true") & (channel == "final") & (recipient == "all")


def bounded(value: int, low: int, high: int, name: str) -> int:
    if isinstance(value, bool) or not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return value


def keyword_hits(messages: DataFrame, query: str, *, thread: str, message: str, text_col: str, role_col: str, time_col: str, title_col: str | None = None, role: str = "user", excluded: DataFrame | None = None, per_thread: int = 1, limit: int = 8) -> DataFrame:
    """Hits of visible messages (role user, assistant or all): in each thread body hits before title hits, users before
    assistants, newest first, then by message id; per_thread of them; of all threads' hits the newest `limit`, then by id."""
    bounded(limit, 1, 20, "limit")
    bounded(per_thread, 1, 20, "per_conversation")
    query = query.strip()
    if not 1 <= len(query) <= 512 or role not in (*ROLES, "all"):
        raise ValueError("query must have 1 to 512 characters, role must be user, assistant or all")
    body = matches(F.col(text_col), query)
    hit = body | matches(F.col(title_col), query) if title_col else body
    found = messages.where(visible(F.col(role_col)) & hit)
    if role != "all":
        found = found.where(F.col(role_col) == role)
    if excluded is not None:
        found = found.join(excluded.select(message), message, "left_anti")
    newest = F.desc(F.coalesce(F.col(time_col), F.lit(0)))
    order = [F.desc(body), F.desc(F.col(role_col) == "user"), newest, F.asc(message)]
    return latest_by(found, [thread], order, per_thread).orderBy(newest, F.asc(message)).limit(limit)


def within_budget(hits: DataFrame, order: list[Column], query: str, text_col: str, budget_chars: int = 6000, most: int = 1400) -> list[dict]:
    """The hits in order, each clipped to `most` characters and to what is left of the budget, until nothing is.

    hits is one page, 20 rows at most; where a clip starts depends on what earlier ones took, so the driver does it."""
    out, left = [], bounded(budget_chars, 500, 40_000, "budget_chars")
    for row in hits.orderBy(*order).limit(20).collect():
        if left <= 0:
            break
        text, size = row[text_col] or "", min(most, left)
        start = max(0, text.casefold().find(query.casefold()) - size // 4) if query else 0
        part = text[start : start + size]
        out.append(row.asDict() | {"text_offset": start, text_col: part, "length": len(text), "truncated": start > 0 or len(text) > size})
        left -= len(part)
    return out


def context_sizes(rows: DataFrame, *, anchored: bool, budget_chars: int = 6000, distance: str = "distance", thread: str = "thread", most: int = 4000) -> DataFrame:
    """rows of context() with text_size: up to `most` characters for the anchor, and an equal share of the rest of the
    budget, up to as many, for each of the others."""
    bounded(budget_chars, 500, 40_000, "budget_chars")
    anchor = min(most, budget_chars) if anchored else 0
    others = F.greatest(F.lit(1), F.count("*").over(Window.partitionBy(thread)) - (1 if anchored else 0))
    share = F.least(F.lit(most), F.floor(F.lit(budget_chars - anchor) / others))
    return rows.withColumn("text_size", (F.when(F.col(distance) == 0, anchor).otherwise(share) if anchored else share).cast("long"))


def source_link(source: Column, base: str = "http://127.0.0.1:8767") -> Column:
    """The reader's address of a source."""
    return F.concat(F.lit(base.rstrip("/") + "/?source="), F.url_encode(source.cast("string")))


def context(messages: DataFrame, anchors: DataFrame, *, thread: str, order: list[Column], message: str, limit: int = 8) -> DataFrame:
    """The messages around each anchor: min(2, limit / 2) before it and the rest behind, limit in all, with their distance.

    anchors (thread, message) is joined once; a thread's messages stay in one partition for their positions."""
    placed = messages.withColumn("position", F.row_number().over(Window.partitionBy(thread).orderBy(*order)) - 1)
    at = anchors.select(thread, message).join(placed.select(thread, message, F.col("position").alias("anchor")), [thread, message]).select(thread, "anchor")
    start = F.greatest(F.lit(0), F.col("anchor") - min(2, limit // 2))
    near = placed.join(at, thread).where((F.col("position") >= start) & (F.col("position") < start + limit))
    return near.withColumn("distance", F.col("position") - F.col("anchor"))


def clipped(rows: DataFrame, query: str, text_col: str, size: int) -> DataFrame:
    parts = clip(F.col(text_col), query, size)
    return rows.select(*[c for c in rows.columns if c != text_col], *[v.alias(text_col if k == "text" else k) for k, v in parts.items()])


def evidence_label(role: Column, action: Column | None = None) -> Column:
    """What kind of evidence a message is; the user's last word on it (quoted, outdated, corrected) comes first."""
    label = F.when(role == "assistant", "assistant_response").otherwise("user_message")
    return label if action is None else F.when(action == "quoted", "quoted_material").when(action.isin("outdated", "corrected"), action).otherwise(label)


#: How sources are cited and what may be concluded from them, by the kind of evidence.
LABELS = {"assistant_response": "历史助手总结：", "user_message": "历史用户消息：", "quoted_material": "用户标明的引用材料："}
NOTES = {
    "assistant_response": "这是历史助手回复，只能引用为助手总结或转述；不是原始邮件、日志或用户自述。",
    "user_message": "这是用户发送的历史消息；仍需区分本人陈述与粘贴引用，不能据此认定为当前事实。",
    "quoted_material": "用户明确标记为引用材料，不能作为用户本人的经历。",
    "outdated": "用户已标记过时或纠正，只可描述当时记录；以反馈与替代消息为准。",
    "corrected": "用户已标记过时或纠正，只可描述当时记录；以反馈与替代消息为准。",
}


def provenance(rows: DataFrame, *, role: str, title: str, action: str, valid_from: str, valid_until: str, as_of: str) -> DataFrame:
    """rows with evidence_status, citation_label, evidence_note and temporal_status: what a message is evidence of, how to cite it
    and where it stands on the day as_of, from its role and the user's last word on it (null action: none)."""
    status = evidence_label(F.col(role), F.col(action))
    spoken = F.when(F.col(role) == "assistant", LABELS["assistant_response"]).otherwise(LABELS["user_message"])
    label = F.when(F.col(action) == "quoted", LABELS["quoted_material"]).otherwise(spoken)
    note = F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])[status]
    said = F.col(action).isNotNull()
    stands = validity(F.when(said, F.col(valid_from)), F.when(said, F.col(valid_until)), as_of, F.coalesce(F.col(action) == "outdated", F.lit(False)))
    return rows.withColumns({"evidence_status": status, "citation_label": F.concat(label, F.coalesce(F.col(title), F.lit(""))), "evidence_note": note, "temporal_status": stands})


def agent_search(messages: DataFrame, branch: DataFrame, feedback: DataFrame, query: str, *, as_of: str, thread: str = "conversation_id", message: str = "message_id", text_col: str = "text", role_col: str = "role", time_col: str = "create_time", title_col: str = "title", role: str = "user", per_thread: int = 1, limit: int = 8, budget_chars: int = 6000, most: int = 1400, base: str = "http://127.0.0.1:8767") -> DataFrame:
    """What an agent is given for a query: rank, thread, message, role, title, time, text_offset, text, text_length, truncated, action,
    valid_from, valid_until, evidence_status, citation_label, evidence_note, temporal_status, reader_url.

    messages are the latest observations, branch (thread, message) the current branches' messages, feedback an append-only log
    (message, entry, action, valid_from, valid_until), of which the last entry counts unless it says restored. Excluded messages
    don't take part. The hits of keyword_hits, newest first, share the budget: each is clipped to `most` characters and to what
    is left, about the place of the match, and hits for which nothing is left are dropped. The page has 20 rows at most: these
    alone are folded in one row."""
    bounded(budget_chars, 500, 40_000, "budget_chars")
    last = feedback.groupBy(message).agg(F.max_by(F.struct("action", "valid_from", "valid_until"), "entry").alias("f")).select(message, "f.*").where("action <> 'restored'")
    on_branch = messages.join(branch.select(thread, message), [thread, message], "left_semi")
    hits = keyword_hits(on_branch, query, thread=thread, message=message, text_col=text_col, role_col=role_col, time_col=time_col, title_col=title_col, role=role, excluded=last.where("action = 'excluded'"), per_thread=per_thread, limit=limit)
    order = F.struct((-F.coalesce(F.col(time_col), F.lit(0)).cast("double")).alias("newest"), F.col(message).alias("id"))
    names = [thread, message, role_col, title_col, time_col, text_col]
    page = hits.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), *names))).alias("page"))
    at = lambda text: F.locate(query.strip().lower(), F.lower(text)) - 1

    def take(acc: Column, row: Column) -> Column:
        text, size = F.coalesce(row[text_col], F.lit("")), F.least(F.lit(most), acc["left"])
        begin = F.greatest(F.lit(0), at(text) - F.floor(size / 4).cast("int"))
        part = F.substring(text, begin + 1, size)
        item = F.struct(begin.alias("text_offset"), part.alias("part"), F.length(text).alias("text_length"), ((begin > 0) | (F.length(text) > size)).alias("truncated"))
        return F.struct((acc["left"] - F.length(part)).alias("left"), F.concat(acc["items"], F.array(item)).alias("items"))

    none = F.array().cast("array<struct<text_offset:int,part:string,text_length:int,truncated:boolean>>")
    folded = F.aggregate("page", F.struct(F.lit(budget_chars).alias("left"), none.alias("items")), lambda a, r: F.when(a["left"] > 0, take(a, r)).otherwise(a))["items"]
    rows = page.select(F.posexplode(F.arrays_zip(F.slice("page", 1, F.size(folded)).alias("hit"), folded.alias("item"))).alias("rank", "x"))
    rows = rows.select((F.col("rank") + 1).alias("rank"), *[F.col(f"x.hit.{n}").alias(n) for n in names if n != text_col], F.col("x.item.text_offset").alias("text_offset"), F.col("x.item.part").alias(text_col), F.col("x.item.text_length").alias("text_length"), F.col("x.item.truncated").alias("truncated"))
    told = rows.join(last, message, "left")
    return provenance(told, role=role_col, title=title_col, action="action", valid_from="valid_from", valid_until="valid_until", as_of=as_of).withColumn("reader_url", source_link(F.col(message), base))


def folded_equal(a: Column, b: Column) -> Column:
    return ascii_lower(a) == ascii_lower(b)
