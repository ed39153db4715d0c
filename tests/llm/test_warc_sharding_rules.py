"""Round trips, laws and counts against plain Python."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestack.llm import rules, sharding, warc


def test_warc_round_trip(spark):
    pages = [(3, "http://a/ b", "x"), (1, None, None), (2, "u", ""), (5, "ü", "x"), (9, "v", "é\r\n\r\nWARC/1.1\r\n"), (7, "w", "y" * 200_000), (8, "w", "x")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, record_id int")
    first = {}
    for i, _, h in sorted(pages, key=lambda p: p[0]):
        first.setdefault(h or "", i)
    want = {(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in pages}
    assert set(map(tuple, warc.round_trip(df, spark).collect())) == want
    assert warc.round_trip(df.limit(0), spark).count() == 0
    captures = warc.assemble(warc.read_archives(warc.write_archives(df, spark))).collect()
    assert len(captures) == len(pages)
    for c in captures:
        page = next(p for p in pages if str(p[0]) == c["metadata"]["fields"]["page-id"])
        assert c["request"]["http_head"].startswith("GET ")
        assert c["response"]["payload"] is None if c["warc_type"] == "revisit" else bytes(c["response"]["payload"]) == (page[2] or "").encode()


def test_every_row_is_a_capture(spark):
    """Repeated and null ids, repeated rows and equal payloads: a row each."""
    pages = [(1, "a", "x"), (1, "a", "y"), (2, "b", "x"), (2, "b", "x"), (None, "c", "x"), (None, None, "z"), (None, None, "z"), (3, "d", "z"), (4, "e", "only"), (None, "f", "alone")]
    pages += [(5, "g", "many")] * 600 + [(6, "h", None), (6, "i", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    ids = {}
    for i, _, h in pages:
        ids.setdefault(h or "", []).append(i)
    first = {h: min((i for i in some if i is not None), default=None) for h, some in ids.items()}
    want = Counter()
    for i, _, h in pages:
        h = h or ""
        kind, ref = ("response", None) if first[h] == i else ("revisit", first[h])
        want[i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), kind, ref] += 1
    assert Counter(map(tuple, warc.round_trip(df, spark).collect())) == want
    records = warc.read_archives(warc.write_archives(df, spark)).where("warc_type <> 'warcinfo'").collect()
    assert len({r["record_id"] for r in records}) == 3 * len(pages)
    responses = {r["record_id"] for r in records if r["warc_type"] == "response"}
    assert all(r["refers_to"] in responses for r in records if r["warc_type"] == "revisit")


def test_cut_short_archives_are_told(tmp_path):
    data = warc.record("metadata", "<a>", "d", b"x: y\r\n")
    import io

    assert len(list(warc.members(io.BytesIO(data * 3)))) == 3
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data + data[:-9])))


def check_shards(rows, texts, shards, tolerance):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    slots, loads = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(loads.values()) / shards
    assert max(abs(loads[k] - mean) for k in range(shards)) <= tolerance * mean


def test_sharding(spark, docs, empty, texts):
    check_shards(sharding.shard(docs, 4).collect(), texts, 4, 3)  # one text is over half of all
    assert sharding.shard(empty).count() == 0
    many = [(i, f"text {i // 2 if i < 400 else i} " + "pad " * (i % 7)) for i in range(2000)] + [(9000 + i, "hot " * 50) for i in range(900)]
    many = [(i, t if i >= 400 else f"pair {i // 2}") for i, t in many]
    rows = sharding.shard(spark.createDataFrame(many, "doc_id long, text string"), 8).collect()
    check_shards(rows, many, 8, 0.02)
    where = defaultdict(set)
    for r in rows:
        if r["doc_id"] < 400:
            where[r["doc_id"] // 2].add(r["shard"])
    assert sum(len(v) > 1 for v in where.values()) <= 4  # pairs stay together


def split_groups(rows, texts):
    where, names = defaultdict(set), dict(texts)
    for r in rows:
        where[names[r["doc_id"]]].add(r["shard"])
    return sum(len(v) > 1 for v in where.values())


def test_links_that_fill_every_shard_hold(spark):
    """20,000 documents that all come in pairs, and 1,600: a cut of under 1 %, sizes even."""
    rng = random.Random(8)
    for n, tolerance in ((20_000, 0.01), (1_600, 0.05)):
        many = [(i, f"pair {i // 2} " + "pad " * (i // 2 % 23)) for i in range(n)]
        rng.shuffle(many)
        rows = sharding.shard(spark.createDataFrame(many, "doc_id long, text string"), 16).collect()
        check_shards(rows, many, 16, tolerance)
        assert split_groups(rows, many) <= n // 2 // 100


def test_group_of_a_third_is_spread_and_others_hold(spark):
    many = [(i, f"group {i // 5} of five" if i < 8_000 else "the same text in a third of rows") for i in range(12_000)]
    rows = sharding.shard(spark.createDataFrame(many, "doc_id long, text string"), 16).collect()
    check_shards(rows, many, 16, 0.02)
    assert split_groups(rows, many) <= 1 + 16


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, lines, len(covered)


def test_rule_counts(spark, docs, empty, texts):
    more = [(100 + i, t) for i, t in enumerate(["a b c a b c", "a a a a", "a b a b a b", "\n\nx\nx\ny\n x\n", "# * | x 你😀", "a b c d\x0ba b c"])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = rules.measured(df).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((i, *brute_counts(t)) for i, t in [*texts, *more])
    assert rules.apply_rules(empty).count() == 0


def test_cascade_order_changes_no_verdict(docs):
    own, lazily = [*rules.BASE, *rules.standard_rules()], rules.over_text("text")
    names = [r.name for r in own]
    verdicts = []
    for order in (names, names[::-1]):
        rows = docs.select("doc_id", lazily(lambda m: rules.cascade(m, own, order)).alias("failed")).collect()
        verdicts.append(sorted((r["doc_id"], r["failed"] is None) for r in rows))
    verdicts.append(sorted((r["doc_id"], r["kept"]) for r in rules.apply_rules(docs).collect()))
    assert verdicts[0] == verdicts[1] == verdicts[2]
    found = rules.calibrate(docs, own, lazily, docs.count())
    assert sorted(x["name"] for x in found) == sorted(names) and [x["rate"] for x in found] == sorted((x["rate"] for x in found), reverse=True)


def test_cascade_works_out_only_what_it_needs(spark):
    """A rule that would fail the job is never reached by rows that an earlier one rejects."""
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    own = [rules.Rule("all", lambda m: m.n_words < 9), rules.Rule("error", lambda m: F.raise_error(F.lit("reached")).cast("boolean"))]
    lazily = rules.over_text("text")
    assert {r[0] for r in df.select(lazily(lambda m: rules.cascade(m, own, ["all", "error"]))).collect()} == {"all"}
    with pytest.raises(Exception, match="reached"):
        df.select(lazily(lambda m: rules.cascade(m, own, ["error", "all"]))).collect()


def test_sample_needs_no_exchange(spark, docs):
    plan = rules.measured(docs.select("text").sample(0.5, 17))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "GlobalLimit" not in plan and plan.rindex("Sample") > plan.rindex("Project")  # sampled before anything is counted
    kept = docs.where(rules.first_failed(docs).isNull())
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rules.apply_rules(docs, sample_rows=3).where("kept").collect())
