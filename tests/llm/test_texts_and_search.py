"""Fill-in-the-middle, ranked search and exact copies against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillspark.llm")
from quillspark.llm import common, exact, fim, queries, search  # noqa: E402

CLASHING = "doc_id long, text string, n long, form string, output string, digest string, run int, best string, score long, rank int, fim_cuts int"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, -1, "f", "o", "d", 7, "b", -2, -3, 4) for i, t in rows], CLASHING)


ODD = [(1, "plain ascii text"), (2, None), (3, ""), (None, "no id here"), (None, None), (4, "ä" * 50 + "😀" * 20 + "abc" * 9 + "漢字" * 30), (4, "same id"), (5, "holds <S> a marker"), (6, "\x00‍\U0010ffff퟿"), (1, "plain ascii text")]


# --- fill in the middle


def brute_middle(i, t, rate=90, spm=20, seed="1"):
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    t = t or ""
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_runs_are_maximal_and_place_every_cut():
    rng = random.Random(5)
    for block in (1, 2, 3, 7, 1 << 20):
        for _ in range(60):
            text = "".join(rng.choice(["a", "bc", "é", "漢", "😀", "x" * 9, "üü"]) for _ in range(rng.randint(0, 40)))
            data, runs = text.encode(), fim.encode(text.encode(), block)
            assert runs.total == len(text) and runs.bytes[-1] == len(data)
            assert all(x != y for x, y in zip(runs.width, runs.width[1:]))
            assert [runs.offset(k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]


def test_middle_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = fim.transform(docs.select("doc_id", "text")).withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_middle(r.doc_id, texts[r.doc_id])
        assert r.restored == (texts[r.doc_id] or "")


def test_middle_on_odd_rows(spark):
    rng = random.Random(2)
    rows = ODD + [(100 + i, "".join(rng.choice("ab<>PSMé漢😀 ") for _ in range(rng.randint(1, 30)))) for i in range(200)]
    rows += [(500, "é" * 700_000 + "x" * 900_000 + "😀" * 300_000), (501, "a" * 3_000_000)]
    for rate, spm in ((90, 20), (100, 100), (100, 0)):
        got = fim.transform(docs_of(spark, rows), rate, spm).withColumn("restored", fim.restore(F.col("output"), F.col("form")))
        assert got.columns[:5] == ["doc_id", "text", "n_", "form_", "output_"]
        got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got.collect())
        assert got == Counter((i, *brute_middle(i, t, rate, spm), t or "") for i, t in rows)
    assert fim.digest(fim.transform(docs_of(spark, []))).count() == 0


def test_middle_moves_no_rows(spark, sf_dir):
    plan = queries.op11_middle(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# --- what earlier operators share


def test_every_special_string_counts(tmp_path):
    """A vocabulary whose special strings begin with other letters is counted as its library does."""
    import json

    from tokenizers import Tokenizer

    from quillspark.llm import tokens

    with open("/opt/tokenizers/word_bpe_49k.json", encoding="utf-8") as f:
        spec = json.load(f)
    more = dict(spec["added_tokens"][0], id=max(t["id"] for t in spec["added_tokens"]) + 60_000, content="[[end]]")
    spec["added_tokens"].append(more)
    path = str(tmp_path / "v.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    library, own = Tokenizer.from_file(path), tokens.PairCounter(path)
    for text in ("one [[end]] two", "[[end]][[end]]", "no mark", "<|endoftext|> [[end]"):
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for own, want in (("64m", 8 << 20), ("67108864b", 8 << 20), ("4096", 4096), ("1kb", None)):
            spark.conf.set(key, own)
            common.bounded(spark)
            assert spark.conf.get(key) == (own if want is None else str(want))
    finally:
        spark.conf.set(key, before)


def test_components_leave_one_table(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(common, "fleeting", lambda s: made.append(str(tmp_path / str(len(made)))) or made[-1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r.component for r in common.components(edges).collect()} == {0}
    import os

    assert len(made) > 5 and sum(map(os.path.exists, made)) == 1


# --- ranked search


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(t):
    return [x.translate({c: c + 32 for c in range(65, 91)}) for x in TERM.findall(t or "")]


def brute_ranks(docs, items, k):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n_docs, words = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c in tf:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def ranks_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 9, 9) for i, t in rows], "item_id long, text string, rank int, doc_id long")


def test_ranks_match_brute_force(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    monkeypatch.setattr(search, "SHARD_WORDS", 2000)  # many shards, hot terms in all of them
    got = search.Index.build(docs)
    assert got.read().count() > 20
    want = brute_ranks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    assert ranks_of(got.search(items)) == want
    monkeypatch.setattr(search, "ITEM_CHARS", 1500)  # items in several blocks
    assert ranks_of(got.search(items)) == want


def test_ranks_on_odd_rows(spark, monkeypatch):
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "délta", "épsilon", "漢字", "x1", "42", "ÀÉ"]
    rows = ODD + [(i % 70, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(200)] + [(300 + i, "beta beta 42") for i in range(60)]
    rows += [(None, "beta 42"), (400, "-- ,, !!"), (401, "w" * 5000 + " beta"), (402, " ".join(rng.choice(words) for _ in range(30_000)))]
    items = [(1, "beta 42"), (1, "alpha ALPHA"), (2, ""), (3, None), (4, "nowhere"), (None, "x1 délta"), (5, "ÀÉ àé gamma"), (6, "漢字")]
    monkeypatch.setattr(search, "SHARD_WORDS", 300)
    monkeypatch.setattr(search, "BLOCK", 64)
    for k in (3, 50, 1000):
        assert ranks_of(search.ranked(docs_of(spark, rows), items_of(spark, items), k)) == brute_ranks(rows, items, k)
    assert search.ranked(docs_of(spark, []), items_of(spark, items)).count() == 0
    assert search.ranked(docs_of(spark, rows), items_of(spark, [])).count() == 0
    assert search.ranked(docs_of(spark, [(1, "--"), (2, None)]), items_of(spark, items)).count() == 0


def test_terms_by_blocks():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "é", "漢", " ", "-", "9", "\x00", "[", "Z", "😀"]) for _ in range(rng.randint(0, 60)))
        for block in (1, 4, 9, 1000):
            assert [t.decode() for part in search.terms_of(text.encode(), block) for t in part] == terms(text)


def test_best_is_tie_safe():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, k = int(rng.integers(1, 40)), int(rng.integers(1, 12))
        scores, places = rng.integers(0, 4, n), rng.permutation(n)
        assert search.best(places, scores, k).tolist() == sorted(range(n), key=lambda i: (-scores[i], places[i]))[:k]


def test_index_is_kept(spark, tmp_path):
    docs = docs_of(spark, [(1, "one two"), (2, "two three three")])
    search.Index.build(docs, str(tmp_path / "index"))
    again = search.Index(spark, str(tmp_path / "index"))
    asked = [(7, "three two")]
    assert ranks_of(again.search(items_of(spark, asked))) == brute_ranks([(1, "one two"), (2, "two three three")], asked, 50)


# --- exact copies


def brute_copies(rows, keep="largest", normal=lambda t: t):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t or "")].append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max(known) if keep == "largest" else min(known)) if known else None
        kept = False
        for i in ids:
            out[i, best, len(ids), i == best and not kept, hashlib.sha256(t.encode()).hexdigest()] += 1
            kept |= i == best
    return out


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_copies_match_brute_force(spark, keep):
    rng = random.Random(1)
    rows = ODD + [(rng.randint(0, 300), rng.choice(["a", "b", "A", "c" * 50, None, ""])) for _ in range(400)] + [(1000 + i, "a third of all") for i in range(400)] + [(2000 + i, f"own {i}") for i in range(300)]
    rows += [(3000, "long " * 500_000), (3001, "long " * 500_000), (3002, "long " * 500_000 + "x")]
    docs = docs_of(spark, rows).repartition(9)
    for bits in (1, 4):
        got = Counter(tuple(r) for r in exact.copies(docs, keep, bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
        assert got == brute_copies(rows, keep)
    left = exact.without_copies(docs, keep)
    assert left.columns == docs.columns
    assert left.count() == len({t or "" for _, t in rows})
    got = Counter(tuple(r) for r in exact.copies(docs, keep, normal=F.lower).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == brute_copies(rows, keep, str.lower)


def test_copies_in_more_groups_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_HOT", 5)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = [(i, f"t{i % 40}") for i in range(200)] + [(1000 + i, "hot") for i in range(300)]
    got = Counter(tuple(r) for r in exact.copies(docs_of(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == brute_copies(rows)


def test_copies_of_nothing(spark):
    assert exact.copies(docs_of(spark, [])).count() == 0
    assert exact.without_copies(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        exact.copies(docs_of(spark, []), "first")


def test_copies_plan_has_no_python(spark, sf_dir):
    plan = queries.op13_copies(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    rows = exact.entries(*common.keyed(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    plan += exact.merged(rows)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "SortAggregate" in plan
