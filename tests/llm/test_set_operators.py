import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import components as components_module
from corpuslens.llm import decontaminate, imatch, ngram_join, shared
from corpuslens.llm import pipeline as stages
from corpuslens.llm.components import connected_components
from corpuslens.llm.shared import Scratch, words_of

DOC = "doc_id long, text string, lang string, source string, n_chars long, n bigint, cls string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "clash") for i, t in docs], DOC)


def components(edges, nodes):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in nodes}


@pytest.mark.parametrize("least", [100_000, 2])
def test_components(spark, monkeypatch, least):
    # with a low bound every node of three edges is a hub
    usual = shared.heavy_above
    monkeypatch.setattr(components_module, "heavy_above", lambda rows: usual(rows, least=least))
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    got = connected_components(spark.createDataFrame([*edges, (None, 1)], "u long, v long"), Scratch(spark, "test"), "c")
    got = {r["node"]: r["label"] for r in got.collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == components([e for e in edges if e[0] != e[1]], nodes)
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test"), "c").count() == 0


def shingle_set(text, width=4):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_force(docs, width=4, percent=85):
    sets = {i: shingle_set(t, width) for i, t in docs}
    ids = [i for i in sets if sets[i]]
    edges = []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                edges.append((a, b))
    return {i: (len(sets[i]), c) for i, c in components(edges, list(sets)).items()}


def near_copies(seed, groups=6, most=30):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(2000)}"
    passage = [word() for _ in range(40)]
    docs = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(3, 150))]
        for _ in range(rng.randint(1, most)):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.2:
                own = own[: rng.randint(1, len(own))]
            if rng.random() < 0.2:
                own += passage
            docs.append(" ".join(own).upper() if rng.random() < 0.1 else "\n".join(own))
    docs += [None, "", "  ", "a b", "A  b", "a b c d", "one"]
    rng.shuffle(docs)
    return list(enumerate(docs, 10))


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"share": 0.05, "block": 3}), (3, {"share": 1.0, "orders": 3, "block": 2}), (6, {"orders": 1})])
def test_join_is_exact(spark, seed, options):
    docs = near_copies(seed)
    got = ngram_join.jaccard_components(frame(spark, docs), **options)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_force(docs)


@pytest.mark.parametrize("share", [0.1, 0.9])
def test_long_lists_with_hot_tokens(spark, monkeypatch, share):
    # every token that any two sets share stands out, so that its lists are dealt to parts
    usual = ngram_join.sketch_bands
    monkeypatch.setattr(ngram_join, "sketch_bands", lambda scanned: usual(scanned) + (hot_cells(scanned) > 1) * 2)
    docs = near_copies(4, groups=2, most=80)
    got = ngram_join.jaccard_components(frame(spark, docs), share=share, block=5)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_force(docs)


def hot_cells(scanned):
    counts = np.zeros(1 << ngram_join.SKETCH_BITS, np.int64)
    width = len(counts) // ngram_join.SKETCH_PARTS
    for r in scanned.where("counts is not null").collect():
        counts[r["part"] * width : (r["part"] + 1) * width] += np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return counts.astype(np.uint8)


def test_join_edges(spark):
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0
    rows = ngram_join.jaccard_components(frame(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, None), (3, "x " * 50_000)])).collect()
    assert len(rows) == 5
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == [(0, 0), (1, 1), (1, 1), (2, 2), (3, 3)]


def test_prefix_filter_is_lossless():
    for n in range(1, 200):
        p = ngram_join.prefix_size(n, 85)
        assert 1 <= p <= n and n - p < -(-85 * n // 100)


# ---- decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def contamination(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - width + 1)) if w else []:
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit.update(range(k, k + n))
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out[i] = (len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("small", [100_000, 0])
def test_contamination_is_exact(spark, small):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(["the", "Of", "ünï", "x1", "word", f"r{rng.randrange(40)}"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 10, 14, 30]))) for i in range(12)] + [(50, None), (51, "!!"), (None, text(12)), (3, text(11)), (60, "the the"), (61, "the the")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, text(5) + " " + items[rng.randrange(12)][1].upper() + ", " + items[rng.randrange(12)][1]) for i in range(30)] + [(300, None), (301, "")]
    got = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), small=small)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()}
    assert got == contamination(docs, items)


def test_contamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.contamination(frame(spark, [(1, "a b"), (1, "a b"), (None, "c")]), none).collect()
    assert len(rows) == 3 and not any(r["contaminated"] for r in rows)
    assert decontaminate.contamination(frame(spark, []), none).count() == 0


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    docs = frame(spark, [(1, "x epsilon beta alpha gamma y"), (2, "alpha x"), (3, "nothing")])
    cut = decontaminate.anchored(decontaminate.windows(items, 5), docs, 100).union(decontaminate.anchored(decontaminate.windows(items, 5), docs, 100)).distinct()
    # delta is in no document, so the window has no exact match and no anchor
    assert cut.count() == 0
    docs = frame(spark, [(1, "x epsilon beta alpha gamma delta"), (2, "delta x")])
    cut = decontaminate.anchored(decontaminate.windows(items, 5), docs, 100)
    index = decontaminate.positional_index(docs, cut.select(F.col("anchor").alias("term")), 4, 100)
    assert {r["doc_id"] for r in decontaminate.proximity_matches(index.where("term is not null"), cut, 0.8).collect()} == {1}
    assert decontaminate.phrase_matches(index.where("term is not null"), cut).count() == 0


@pytest.mark.parametrize("small", [100_000, 0])
def test_near_contamination_is_complete(spark, small):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=14))) for i in range(6)] + [(None, None), (70, "one two")]
    docs = [(i, " ".join(rng.choices(vocabulary, k=40))) for i in range(20)] + [(None, None), (900, "two one"), (900, "two one"), (900, "x one")]
    for i in range(6):
        w = items[i][1].split()[2:12]
        w[rng.randrange(10)] = "misspelt"
        rng.shuffle(w)
        docs.append((100 + i, "some text " + " ".join(w) + " more of it"))
    got = decontaminate.near_contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), small=small).collect()
    assert len(got) == len(docs)
    near = {}
    for r in got:
        near.setdefault(r["doc_id"], []).append(set(r["near_item_ids"]))
    assert sorted(map(len, near[900])) == [0, 1, 1]
    cut = {(i, tuple(t.split()[k : k + 10])) for i, t in items if t for k in range(max(1, len(t.split()) - 9))}
    for i, t in docs[:20] + docs[24:]:
        w = t.split()
        due = {str(k) for k, x in cut for s in range(len(w)) if len(set(w[s : s + 10]) & set(x)) >= -(-len(set(x)) * 8 // 10)}
        assert due <= near[i][0], i
    assert all(str(i) in near[100 + i][0] for i in range(6))


def test_a_changed_rarest_word_is_found(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    docs = frame(spark, [(1, "x epsilon beta alpha gamma y"), (2, "alpha x"), (3, "nothing")])
    got = {r["doc_id"]: r["n_near"] for r in decontaminate.near_contamination(docs, items, width=5).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_native_plans_have_no_python(spark):
    docs = frame(spark, [(1, "a b c"), (2, "b c d")])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for df in (decontaminate.contamination(docs, items), imatch.edit_fingerprints(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ---- fingerprints


@pytest.mark.parametrize("buckets", [1, 7])
def test_edited_texts(spark, buckets):
    rng = random.Random(8)
    docs = [(i * 3 - 20, "".join(rng.choice("ab é😀.") for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(1000, None), (1001, "same text here"), (1002, "same text here")]
    got = {r["doc_id"]: r for r in imatch.edit_fingerprints(frame(spark, docs), buckets=buckets).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[1001]["fingerprint"] == got[1002]["fingerprint"] and got[1001]["near_next"] == 1.0


def fingerprints_by_hand(spark, docs, low, high, subsets, halvings):
    """Every column by loops; only the 64-bit hashes are asked from Spark."""
    rows = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    texts = [t or "" for _, t in rows]
    new = [t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2] for k, t in enumerate(texts)]
    split = lambda t: {w for w in re.split(r"[^\w]+|_", t.lower()) if w}
    df = Counter(w for t in texts for w in split(t))
    band = sorted(w for w, n in df.items() if max(2, low * len(rows)) <= n <= max(2, high * len(rows)))
    cells = [F.xxhash64(F.lit(k), "w") for k in range(halvings)]
    masks = {w: -1 for w in band}
    for r in spark.createDataFrame([(w,) for w in band] or [("",)], "w string").select("w", *cells).collect():
        for h in r[1:]:
            if r[0] in masks:
                masks[r[0]] &= h

    def marks(t):
        own = sorted(w for w in split(t) if masks.get(w))
        return {k: tuple(w for w in own if masks[w] >> k & 1) for k in range(subsets) if any(masks[w] >> k & 1 for w in own)} if own else {subsets: t} if t else {}

    near = lambda a, b: sum(a[k] == b.get(k) for k in a) / len(a.keys() | b.keys()) if a or b else 0.0
    f = [marks(t) for t in texts]
    return [(r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), f[k], marks(e), near(f[k], marks(e)), near(f[k], f[(k + 1) % len(f)])) for k, (r, t, e) in enumerate(zip(rows, texts, new, strict=True))]


@pytest.mark.parametrize("buckets", [1, 5])
def test_fingerprints_against_brute_force(spark, buckets):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(80)] + ["Ünï", "É"]
    docs = [(3 * i, " ".join(rng.choices(words, weights=range(82, 0, -1), k=rng.randint(0, 60)))) for i in range(70)] + [(None, "no id w1"), (900, None), (901, "zzz qqq"), (902, docs_text := "w3 w4, w5 W6"), (903, docs_text)]
    got = {r["doc_id"]: r for r in imatch.edit_fingerprints(frame(spark, docs), low=0.05, high=0.6, subsets=64, halvings=2, buckets=buckets).collect()}
    due = fingerprints_by_hand(spark, docs, 0.05, 0.6, 64, 2)
    assert len(got) == len(due)
    shown = {}
    for i, n, sha, f, e, near_edited, near_next in due:
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(near_edited), pytest.approx(near_next)), i
        # equal marks, and only they, are shown alike
        for marks, text in ((f, r["fingerprint"]), (e, r["edited_fingerprint"])):
            assert shown.setdefault(text, marks) == marks and len(text) == 10 * len(marks)
    assert len(shown) == len({repr(sorted(m.items())) for m in shown.values()})


def test_fingerprints_tell_texts_apart(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(600)]
    docs = [(i, " ".join(rng.choices(words, k=80))) for i in range(200)]
    rows = imatch.edit_fingerprints(frame(spark, docs), low=0.01, high=0.5).collect()
    near = lambda c: sum(r[c] for r in rows) / len(rows)
    assert near("near_edited") > 3 * near("near_next")


def test_fingerprint_edges(spark):
    assert imatch.edit_fingerprints(frame(spark, [])).count() == 0
    alone = imatch.edit_fingerprints(frame(spark, [(5, "only one text")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"only on" + b"only o").hexdigest()
    rows = imatch.edit_fingerprints(frame(spark, [(1, "a"), (1, "b"), (None, "c")])).collect()
    assert len(rows) == 3


# ---- the pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    clean = [(i, f"plain words of document number {i} with its own tail " + " ".join(f"t{i}x{k}" for k in range(30))) for i in range(12)]
    item = "secret benchmark passage of exactly ten words or a few more here"
    docs = [*clean, (50, clean[3][1]), (60, "12345 !!"), (61, None), (70, "before " + item + " after it all"), (80, "write to me@x.org about this and nothing else today please")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, seen = frame(spark, docs).drop("n", "cls"), []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        seen.append((name, at.count()))
        if name != "sentencepiece":
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "pii":
            assert at.where("doc_id = 80").first()["text"] == "write to <EMAIL> about this and nothing else today please"
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
    assert dict(seen) == {"language_id": 15, "ngram_jaccard_join": 14, "decontamination": 13, "pii": 13, "sentencepiece": 13}


def test_rows_are_kept_and_dropped_by_their_own_text(spark, tmp_path):
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    item = "secret benchmark passage of exactly ten words or a few more here"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, [(None, own(1)), (None, own(2) + " " + item), (7, own(3)), (7, own(4)), (7, own(4)), (9, own(4)), (8, item), (8, own(5)), (None, None)])
    texts = lambda df: sorted((r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    kept = stages.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert texts(kept) == sorted([(0, own(1)), (0, own(2) + " " + item), (7, own(3)), (7, own(4)), (8, item), (8, own(5)), (0, "")])
    clean = stages.decontaminated(spark, docs, str(tmp_path))
    assert texts(clean) == sorted([(0, own(1)), (7, own(3)), (7, own(4)), (7, own(4)), (9, own(4)), (8, own(5)), (0, "")])


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls in every column, repeated rows and extra columns with names of the operators' own."""
    item = "secret benchmark passage of exactly ten words or a few more here"
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = DOC + ", score double, lang_pred string, ids array<int>, component_id string"
    rows = [(i, t, x, None, None, i, "c", 0.5, "zz", [1], "k") for i, t, x in [(1, "some plain words here", "en"), (1, "some plain words here", "en"), (None, "no id at all", None), (2, None, None), (3, "", "fr"), (4, item, None), (None, None, None)]]
    for data in (rows, []):
        at = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == spark.createDataFrame([], schema).columns, name
            at.write.parquet(str(tmp_path / f"{name}-{len(data)}"))
            at = spark.read.parquet(str(tmp_path / f"{name}-{len(data)}"))
        assert sorted((r["doc_id"] or 0, r["text"], r["score"]) for r in at.collect()) == ([(0, "no id at all", 0.5), (1, "some plain words here", 0.5)] if data else [])
        done = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
        assert done.columns == ["doc_id", "ids", "n_tokens"] and done.count() == (2 if data else 0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_against_brute_force(spark):
    from corpuslens.llm import pii, sentencepiece_codec

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    first = brute_force(kept, 5, 80)
    kept = [(i, t) for i, t in kept if first[i][1] == i]
    bad = contamination(kept, items)
    texts = {i: pii.redact(t) for i, t in kept if not bad[i][4]}
    codec = sentencepiece_codec.Codec(open(sentencepiece_codec.default_model(), "rb").read())
    expected = dict(zip(texts, (x.tolist() for x in codec.encode(list(texts.values()))), strict=True))
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == expected


def test_stages_leave_no_memory_to_the_next(spark, tmp_path, monkeypatch):
    """Python workers live on from stage to stage: each function of a stage gives its memory back, and drops another's model."""
    made, given, frames = [], [], type(spark.range(0))
    map_in_arrow = frames.mapInArrow
    monkeypatch.setattr(frames, "mapInArrow", lambda df, run, *rest: made.append(run) or map_in_arrow(df, run, *rest))
    spark.createDataFrame([(1, "a passage that is in none of the documents here at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, near_copies(5, groups=2))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path))
    assert len(made) >= 10
    monkeypatch.setattr(shared, "give_back", lambda: given.append(1))
    for i, run in enumerate(made):
        shared.kept("another's", object)
        before = len(given)
        list(run(iter(())))
        assert len(given) > before and "another's" not in shared._KEPT, run.__qualname__
    shared.forget()


def test_counts_of_docs(spark):
    docs = near_copies(5, groups=2)
    rows = ngram_join.jaccard_components(frame(spark, docs)).collect()
    copies = Counter(frozenset(shingle_set(t)) for _, t in docs)
    assert all(r["n_copies"] == copies[frozenset(shingle_set(dict(docs)[r["doc_id"]]))] for r in rows if r["n_shingles"])
