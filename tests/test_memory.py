import pytest

from threadloom.operators import memory, recall, search, semantic
from threadloom.streaming import sessions


def test_scan_review_and_edit(spark):
    rows = spark.createDataFrame([("m1", "user", "I prefer tea over coffee."), ("m2", "user", "I  prefer tea over coffee."), ("m3", "user", "Please don't call me."), ("m4", "assistant", "I prefer tea.")], "id string, role string, text string")
    found = memory.scan_candidates(rows, message="id", text_col="text", role_col="role")
    assert {(r["id"], r["kind"]) for r in found.collect()} == {("m1", "preference"), ("m2", "preference"), ("m3", "boundary")}
    assert memory.scan_candidates(rows, message="id", text_col="text", role_col="role", existing=found).count() == 0
    ids = [r["candidate_id"] for r in found.orderBy("id").collect()]
    log = spark.createDataFrame([], "candidate_id string, status string, note string, decided_at string")
    log = memory.decide(memory.decide(log, ids[:2], "confirmed", "2024-01-01"), ids[1:2], "rejected", "2024-01-02")
    edits = spark.createDataFrame([(ids[0], "I like tea.", "2024-01-03")], "candidate_id string, statement string, edited_at string")
    state = {r["candidate_id"]: r for r in memory.review_state(found, log, edits).collect()}
    assert [state[i]["status"] for i in ids] == ["confirmed", "rejected", "pending"]
    assert state[ids[0]]["statement"] == "I like tea." and state[ids[0]]["original"] == "I prefer tea over coffee."
    assert [r["relation"] for r in memory.related(found, found.where(f"candidate_id = '{ids[0]}'")).collect()] == ["duplicate"]
    with pytest.raises(ValueError):
        memory.decide(log, ids, "unknown", "x")


def test_explicit_statements_and_budget(spark):
    rows = spark.createDataFrame(
        [
            ("m", "I like rain. Do I like sun?\n> I like quoted lines.\n  ```py\nI am code inside here.\n```\nMy cat sleeps.\r\n“I want this quoted.\nI want  tea！我喜欢下雨天。I am", 2.0),
            ("n", "I like RAIN.\n```\nI want no end", 3.0),
            ("o", "i like rain.", None),
        ],
        "id string, text string, at double",
    )
    got = memory.explicit_statements(rows)
    assert sorted((r["id"], r["kind"], r["statement"]) for r in got.collect()) == [("m", "preference", "I like rain."), ("m", "preference", "I want  tea！"), ("m", "preference", "我喜欢下雨天。"), ("n", "preference", "I like RAIN."), ("o", "preference", "i like rain.")]
    groups = memory.consolidate(got, kind="kind", text_col="statement", source="id", time_col="at", keep_sources=2)
    first = groups.collect()[0]
    assert first["norm"] == "i like rain." and first["statement"] == "I like RAIN." and first["n_sources"] == 3 and first["sources"] == ["n", "m"]
    assert [r["norm"] for r in memory.greedy_budget(groups, "norm", budget_chars=13)] == ["i like rain."]


def test_related_takes_the_whole_texts_ratio(spark):
    import difflib

    rows = [("a", "I want to learn the cello."), ("b", "I never want to learn the cello."), ("c", "I want to learn the violin."), ("d", "I want x"), ("e", "i want  to learn the CELLO.")]
    found = spark.createDataFrame([(i, "plan", s, "t1" if i in "ad" else "t2") for i, s in rows], "candidate_id string, kind string, statement string, thread string")
    got = {r["candidate_id"]: (r["relation"], r["score"]) for r in memory.related(found, found.where("candidate_id = 'a'"), thread="thread").collect()}
    one = "i want to learn the cello."
    ratio = lambda x: difflib.SequenceMatcher(None, one, x).ratio()
    assert got["e"] == ("duplicate", 1.0) and got["b"] == ("possible_conflict", 1.0)
    assert got["c"] == ("related", round(ratio("i want to learn the violin."), 3))
    assert got.get("d") == (("related", round(ratio("i want x") + 0.08, 3)) if ratio("i want x") >= 0.42 else None)


def test_remember_profile_and_feedback(spark):
    from threadloom.operators import annotations

    messages = spark.createDataFrame([("m1", "user", "I like rain a lot"), ("m2", "assistant", "You like rain"), ("m3", "user", "I like sun")], "message_id string, role string, text string")
    none = spark.createDataFrame([], "message_id string, quote string, kind string, created_at string")
    kept = memory.remember(none, messages, "m1", "I like rain", "2024-01-01")
    assert memory.remember(kept, messages, "m1", "I like rain", "2024-01-02").count() == 1
    for bad in (("m2", "You like rain"), ("m1", "i like rain"), ("m1", " "), ("m9", "x")):
        with pytest.raises(ValueError):
            memory.remember(kept, messages, *bad, "2024-01-01")
    log = spark.createDataFrame([], annotations.FEEDBACK)
    for i, (message, action) in enumerate([("m1", "outdated"), ("m3", "excluded"), ("m3", "restored")]):
        log = annotations.add_feedback(log, message, action, f"2024-02-0{i + 1}T00:00:00")
    assert [(r["id"], r["valid_until"]) for r in log.orderBy("id").collect()] == [(1, "2024-02-01"), (2, None), (3, None)]
    for bad in ({"action": "gone"}, {"action": "corrected"}, {"action": "quoted", "valid_from": "2024-02-02", "valid_until": "2024-02-01"}):
        with pytest.raises(ValueError):
            annotations.add_feedback(log, "m1", at="2024-01-01", **bad)
    confirmed = spark.createDataFrame([("m3", "I like sun", "preference"), ("m1", "I like rain", "preference"), ("m9", "gone", "plan")], "message_id string, statement string, kind string")
    got = {(r["message_id"], r["status"], r["state"]) for r in memory.profile(confirmed, kept, messages, log).collect()}
    assert got == {("m1", "confirmed", "historical"), ("m3", "confirmed", "current")}
    places = spark.createDataFrame([("s", "c", "m1", 1), ("s", "c", "m3", 2)], "snapshot_key string, conversation_id string, message_id string, updated_at int")
    assert [r["message_id"] for r in annotations.positions(places).collect()] == ["m3"]


def test_budget_goes_on_past_many_long_statements(spark):
    from pyspark.sql import functions as F

    rows = [(i, "x" * 80) for i in range(900)] + [(900, "y" * 15), (901, "z" * 30), (902, "w" * 5)]
    groups = spark.createDataFrame(rows, "i int, norm string").repartition(8).orderBy(F.asc("i"))
    assert [r["i"] for r in memory.greedy_budget(groups, "norm", budget_chars=100)] == [0, 900, 902]
    assert [r["i"] for r in memory.greedy_budget(groups, "norm", budget_chars=100, most=1)] == [0]


def test_hits_and_budget(spark):
    rows = spark.createDataFrame([("c1", "m1", "user", "alpha beta", 1.0), ("c1", "m2", "assistant", "alpha", 2.0), ("c2", "m3", "assistant", "x alpha", 3.0), ("c2", "m4", "system", "alpha", 4.0), ("c3", "m5", "user", "z" * 2000 + "Alpha" + "y" * 2000, None)], "thread string, message string, role string, text string, at double")
    names = {"thread": "thread", "message": "message", "text_col": "text", "role_col": "role", "time_col": "at"}
    found = lambda **more: [r["message"] for r in recall.keyword_hits(rows, " ALPHA", **names, **more).collect()]
    assert found() == ["m1", "m5"] and found(role="all") == ["m3", "m1", "m5"] and found(role="assistant", per_thread=2) == ["m3", "m2"]
    assert found(role="all", excluded=spark.createDataFrame([("m3",)], "message string")) == ["m1", "m5"] and found(limit=1) == ["m1"]
    for bad in ({"limit": 21}, {"per_thread": 0}, {"role": "any"}):
        with pytest.raises(ValueError):
            found(**bad)
    from pyspark.sql import functions as F

    got = recall.within_budget(recall.keyword_hits(rows, "alpha", **names), [F.desc(F.coalesce("at", F.lit(0)))], "alpha", "text", budget_chars=500)
    assert [(x["message"], x["text_offset"], len(x["text"]), x["truncated"]) for x in got] == [("m1", 0, 10, False), ("m5", 2000 - 490 // 4, 490, True)]
    near = recall.context(rows, rows.where("message = 'm1'"), thread="thread", order=[F.asc("at")], message="message")
    assert {r["message"]: r["text_size"] for r in recall.context_sizes(near, anchored=True, budget_chars=6000).collect()} == {"m1": 4000, "m2": 2000}


def test_chunks_and_fusion(spark):
    rows = spark.createDataFrame([(1, "a" * 600 + "b" * 301), (2, ""), (3, "x")], "id long, text string")
    assert sorted((r["id"], r["chunk_offset"], len(r["chunk"])) for r in semantic.chunks(rows).collect()) == [(1, 0, 600), (1, 500, 401), (3, 0, 1)]
    from pyspark.sql import functions as F

    ranks = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, 1.0)], "r int, s double")
    got = {x["r"]: round(x["fused"], 9) for x in semantic.fuse_ranks(ranks, [F.asc("r")], [F.desc("s")]).collect()}
    assert got[1] == got[3] > got[2]


def test_overlapping_occurrences(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("AAAA",), ("b",)], "t string")
    assert [r[0] for r in rows.select(search.occurrences(F.col("t"), "aaa")).collect()] == [2, 0]


def test_session_stream_is_idempotent(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text('{"type":"message","id":"a","message":{"role":"user","content":"x"}}\n')
    for _ in range(2):
        sessions.append_sessions(spark, str(logs), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    (logs / "b.jsonl").write_text('{"type":"message","id":"b","message":{"role":"user","content":"y"}}\n')
    sessions.append_sessions(spark, str(logs), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b"]


def test_agent_search_in_one_result(spark):
    from threadloom.operators import recall

    messages = [("c", f"m{i}", "user" if i % 2 == 0 else "assistant", f"Title {i}", float(i), "x" * (300 * i) + " needle " + "y" * 2000) for i in range(6)] + [("d", "m9", "user", "Needle here", None, None), ("c", "gone", "user", "t", 9.0, "needle off the branch")]
    df = spark.createDataFrame(messages, "conversation_id string, message_id string, role string, title string, create_time double, text string")
    branch = df.where("message_id <> 'gone'").select("conversation_id", "message_id")
    log = [("m5", 1, "excluded", None, None), ("m5", 2, "restored", None, None), ("m4", 3, "excluded", None, None), ("m3", 4, "quoted", "2024-01-01", "2024-02-01"), ("m2", 5, "corrected", None, "2023-01-01"), ("m0", 6, "outdated", None, None)]
    feedback = spark.createDataFrame(log, "message_id string, entry int, action string, valid_from string, valid_until string")
    rows = recall.agent_search(df, branch, feedback, "Needle", as_of="2024-01-15", role="all", per_thread=20, limit=20, budget_chars=3000).orderBy("rank").collect()
    left, want = 3000, []
    for _, m, _, _, _, text in sorted((x for x in messages if x[1] not in ("gone", "m4")), key=lambda x: (-(x[4] or 0), x[1])):
        if left <= 0:
            break
        size = min(1400, left)
        start = max(0, (text or "").lower().find("needle") - size // 4)
        part = (text or "")[start : start + size]
        want.append((m, start, part, len(text or ""), start > 0 or len(text or "") > size))
        left -= len(part)
    assert [(r.message_id, r.text_offset, r.text, r.text_length, r.truncated) for r in rows] == want and len(want) == 3
    every = {r.message_id: r for r in recall.agent_search(df, branch, feedback, "needle", as_of="2024-01-15", role="all", per_thread=20, limit=20, budget_chars=40_000).collect()}
    assert {m: (r.evidence_status, r.temporal_status) for m, r in every.items()} == {"m0": ("outdated", "outdated"), "m1": ("assistant_response", "historical_unverified"), "m2": ("corrected", "expired"), "m3": ("quoted_material", "within_user_stated_period"), "m5": ("assistant_response", "historical_unverified"), "m9": ("user_message", "historical_unverified")}
    assert every["m3"].citation_label == recall.LABELS["quoted_material"] + "Title 3" and every["m2"].evidence_note == recall.NOTES["corrected"] and every["m9"].reader_url.endswith("/?source=m9")
    assert recall.agent_search(df.limit(0), branch, feedback, "needle", as_of="2024-01-15").collect() == []


def test_profile_dates_and_observed_statements(spark):
    confirmed = spark.createDataFrame([(f"m{i}", f"s{i}", "plan") for i in range(7)], "message_id string, statement string, kind string")
    none = spark.createDataFrame([], "message_id string, quote string, kind string, created_at string")
    messages = spark.createDataFrame([(f"m{i}",) for i in range(7)], "message_id string")
    log = [("m1", 1, "corrected", "2024-01-01", "2024-02-01"), ("m2", 2, "corrected", None, "2023-12-31"), ("m3", 3, "corrected", "2024-02-01", None), ("m4", 4, "outdated", "2024-01-01", None), ("m5", 5, "excluded", None, None), ("m6", 6, "quoted", "2024-01-01", None), ("m6", 7, "restored", "2024-01-01", None)]
    feedback = spark.createDataFrame(log, "message_id string, id int, action string, valid_from string, valid_until string")
    got = {r.message_id: (r.state, r.temporal_status) for r in memory.profile(confirmed, none, messages, feedback, as_of="2024-01-15").collect()}
    assert got == {"m0": ("current", "historical_unverified"), "m1": ("historical", "within_user_stated_period"), "m2": ("historical", "expired"), "m3": ("historical", "future"), "m4": ("historical", "outdated"), "m6": ("current", "historical_unverified")}
    said = spark.createDataFrame([(f"m{i}", "I prefer tea.", float(i)) for i in range(7)] + [("m8", None, 1.0), ("m9", "I PREFER  tea.", None)], "message_id string, text string, create_time double")
    (group,) = memory.observed_profile(said, feedback.withColumnRenamed("id", "entry")).collect()
    assert (group.n_sources, [tuple(x) for x in group.sources], group.newest) == (4, [("m6", None), ("m4", "outdated"), ("m0", None)], 6.0)
