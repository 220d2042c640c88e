import random
import re
from collections import Counter

from threadloom.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def norm(line):
    return " ".join(WORD.findall(line)).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def frequent(rows, min_pages, share):
    pages, holds = Counter(), Counter()
    for _, text, host in rows:
        pages[host] += 1
        for line in {norm(x) for x in (text or "").split("\n") if WORD.search(x)}:
            holds[host, line] += 1
    return {k for k, v in holds.items() if v >= min_pages and v > share * pages[k[0]]}


def corpus():
    r = random.Random(6)
    words = ["w%d" % i for i in range(50)]
    common = ["Cookie  notice", "All pages\tlink here", "漢字 Fuß"]
    rows = []
    for i in range(120):
        host = r.choice(["a", "a", "b", None])
        body = [" ".join(r.choices(words, k=r.randint(0, 30))) for _ in range(r.randint(0, 6))]
        body += [c if r.random() < 0.5 else c.upper() for c in common if r.random() < 0.4]
        r.shuffle(body)
        rows.append((i, "\n".join(body), host))
    rows += [(200, None, "a"), (201, "", "a"), (202, " \n\t\n", "b"), (203, rows[5][1], rows[5][2]), (203, rows[5][1], rows[5][2]), (204, "a b c a b c a b c d " * 10, "a"), (205, "!\n!\n!", None)]
    return rows


def test_line_dedup_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS host", "1 AS frequent")
    for limit in (100_000, 0):
        got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in lines.drop_frequent_lines(docs, min_pages=5, max_share=0.2, broadcast_rows=limit).collect())
        bad = frequent(rows, 5, 0.2)
        want = []
        for i, text, host in rows:
            parts = (text or "").split("\n")
            solid = [bool(WORD.search(x)) for x in parts]
            gone = [s and (host, norm(x)) in bad for x, s in zip(parts, solid, strict=True)]
            want.append((i, sum(solid), sum(gone), "\n".join(x for x, g in zip(parts, gone, strict=True) if not g)))
        assert bad and got == sorted(want)


def test_quality_rules_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "0 AS h", "0 AS line")
    got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["words_left"], r["kept"]) for r in lines.quality_rules(docs, min_pages=5, max_share=0.2, min_left=0.9).collect())
    bad, want = frequent(rows, 5, 0.2), []
    for i, text, host in rows:
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[j : j + 3]) for j in range(len(words) - 2))
        inside = {j + k for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for k in range(3)}
        solid = [x for x in (text or "").split("\n") if WORD.search(x)]
        left = len(words) - sum(len(WORD.findall(x)) for x in solid if (host, norm(x)) in bad)
        failed = len(words) < 50 or 2 * len(inside) > len(words)
        want.append((i, len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(solid) - len(set(solid)), len(inside), failed, left, not failed and left >= 0.9 * len(words)))
    assert got == sorted(want) and {w[-1] for w in want} == {True, False}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert lines.quality_rules(docs).collect() == [] and lines.drop_frequent_lines(docs).collect() == []


def test_copies_count_as_documents_and_depleted_ones_are_rejected(spark):
    r = random.Random(3)
    own = lambda: "\n".join(" ".join("u%d" % r.randrange(10**6) for _ in range(12)) for _ in range(6))
    copied, footer = own(), " ".join("f%d" % i for i in range(20))
    rows = [(i, copied, "a") for i in range(30)] + [(i, own() + "\n" + footer, "a") for i in range(30, 100)] + [(i, own(), "b") for i in range(100, 105)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x["doc_id"]: x for x in lines.quality_rules(docs).collect()}
    assert {i for i, x in got.items() if not x["kept"]} == set(range(30)) and not any(x["base_failed"] for x in got.values())
    assert {x["words_left"] for i, x in got.items() if 30 <= i < 100} == {72}
    cut = {x["doc_id"]: x for x in lines.drop_frequent_lines(docs).collect()}
    assert {x["n_dropped"] for i, x in cut.items() if i < 30} == {6} and {x["n_dropped"] for i, x in cut.items() if 30 <= i < 100} == {1} and {x["n_dropped"] for i, x in cut.items() if i >= 100} == {0}
