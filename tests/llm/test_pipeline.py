"""The pipeline, stage by stage, against plain Python on small tables."""

import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lociflow.llm import mixing, pieces, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed=1):
    """(documents, labels): copies, near copies, toxic texts, null and empty ones, repeated rows and null ids."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    texts = []
    for _ in range(40):
        base = word(int(rng.integers(20, 60)))
        texts.append(" ".join(base))
        if rng.random() < 0.4:
            texts.append("  ".join(base) + ("\n" if rng.random() < 0.5 else ""))
        if rng.random() < 0.4:
            texts.append(" ".join([*base[:-1], "other"]))
    texts += [" ".join([*word(30), "you", "vile", "idiot"]) for _ in range(30)]
    texts += [None, "", " ", "one two", "two one"]
    rows = [(i, t, "en", ("a", "b", "c", "d", None)[min(4, int(rng.exponential(1)))], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[0], "en", "a", 1), (None, "lone text of no id", "en", "a", 1)]
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t in enumerate(texts)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels = made()
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCUMENTS).withColumns({"size": F.lit(1), "n": F.lit(2), "kept": F.lit(3), "score": F.lit(4.5), "taken": F.lit("x")}).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def key(r):
    return (r.doc_id, r.text, r.source)


def in_order(rows):
    return sorted(rows, key=str)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_mixed(rows, weights=(5, 2, 1), share=1.5, most=2):
    """The mix of (doc_id, text, source) rows, by the rule: targets by weight, capped and shared anew; whole passes,
    then documents in the order of their keys."""
    size = lambda t: len(WORD.findall(t or ""))
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    target, left, free = {}, share * sum(total.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: float(most * total[s]) for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out = []
    for s in names:
        budget = round(target[s])
        passes, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        for d, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: md5(("" if r[0] is None else str(r[0])) + ":" + md5(r[1] or ""))):
            n = size(t)
            if not n:
                out.append((d, t, s))
                continue
            cut = min(rest, n)
            rest -= cut
            whole, part = divmod(passes * n + cut, n)
            out += [(d, t, s)] * whole
            if part:
                out.append((d, t[: list(WORD.finditer(t))[part - 1].end()], s))
    return out


def test_stages_one_by_one(spark, tables):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "pieces"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")

    # what the machine scores below the threshold stays, as pairwise sums say
    clean = stages["toxicity"](spark, docs, tables)
    assert clean.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    terms = toxicity.Terms(model.bits, model.places)
    stays = lambda t: 1 / (1 + math.exp(-pairwise(model, sorted(toxicity._of_text((t or "").encode(), terms))))) < 0.3
    first = clean.collect()
    assert in_order(first) == in_order(r for r in docs.collect() if stays(r.text))
    assert not any("idiot" in (r.text or "") for r in first) and len(first) >= docs.count() - 30

    alone = stages["exact_dedup"](spark, clean, tables)
    assert alone.columns == docs.columns
    best = {}
    for r in first:
        k = normal(r.text)
        if k not in best or (r.doc_id is None, r.doc_id or 0) < (best[k].doc_id is None, best[k].doc_id or 0):
            best[k] = r
    second = alone.collect()
    assert in_order(map(key, second)) == in_order(map(key, best.values()))

    apart = stages["near_dedup"](spark, alone, tables)
    assert apart.columns == docs.columns
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (WORD.findall(r.text or "") for r in second)]
    group = list(range(len(second)))
    for a, b in itertools.combinations(range(len(second)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            one, other = group[a], group[b]
            group = [one if g == other else g for g in group]
    keep = {}
    for k, r in zip(group, second):
        if k not in keep or (r.doc_id is None, r.doc_id or 0) < (keep[k].doc_id is None, keep[k].doc_id or 0):
            keep[k] = r
    third = apart.collect()
    assert in_order(map(key, third)) == in_order(map(key, keep.values())) and len(third) < len(second)

    mix = stages["mixing"](spark, apart, tables)
    assert mix.columns == docs.columns
    fourth = mix.collect()
    assert in_order(map(key, fourth)) == in_order(brute_mixed([key(r) for r in third]))

    last = stages["pieces"](spark, mix, tables).collect()
    table = pieces.Pieces(pieces.Settings())
    exp = [(r.doc_id, np.frombuffer(table.encode(r.text or "")[0], np.int32).tolist()) for r in fourth]
    assert in_order((r.doc_id, r.pieces) for r in last) == in_order(exp) and all(r.round_trip for r in last if r.n_pieces)


def pairwise(model, terms):
    return model.bias + sum(model.weights[i] for i in terms) + sum(float(model.vectors[i] @ model.vectors[j]) for i, j in itertools.combinations(terms, 2))


def test_run_is_the_stages(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    pick = ["doc_id", "source", "n_pieces", "pieces"]
    assert in_order(out.select(pick).collect()) == in_order(docs.select(pick).collect())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixes_against_loops(spark):
    rng = np.random.default_rng(2)
    for sources in (("a",), ("a", "b"), (None, "x", "y", "z", "q")):
        rows = [(int(rng.integers(0, 60)), " ".join(["w"] * int(rng.integers(0, 40))) or None, sources[min(len(sources) - 1, int(rng.exponential(0.7)))]) for _ in range(80)]
        rows += rows[:3]
        got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert in_order(map(key, got)) == in_order(brute_mixed(rows))


def test_machine_against_pairs():
    rng = np.random.default_rng(3)
    model = toxicity.Machine({k: k for k in range(12)}, 20, 0.3, rng.normal(size=12), rng.normal(size=(12, 4)))
    rows = [sorted(rng.choice(12, n, replace=False).tolist()) for n in (0, 1, 2, 5, 12)]
    flat, at = np.array([x for r in rows for x in r], np.int64), np.cumsum([0, *map(len, rows)])
    assert np.allclose(model.logit(flat, at), [pairwise(model, r) for r in rows])


def test_pairs_matter(spark):
    """Neither word alone is toxic, both together are: a linear weight can't tell."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)]
    rows, marks = [], []
    for i in range(3000):
        both = i % 4
        text = [*rng.choice(words, 10), *(["rotten"] if both & 1 else []), *(["foreigners"] if both & 2 else [])]
        rows.append((i, " ".join(rng.permutation(text))))
        marks.append((i, int(both == 3)))
    extra = [(i, t) for i, t in rows[:200]] + [(None, "rotten foreigners"), (-1, None), (-2, "")]
    labels = [*marks, (0, None), (1, 7), (3, 0), (-5, 1)]
    docs = spark.createDataFrame([*rows, *extra], "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    out = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id >= 0]
    assert len(held) > 500 and np.mean([r.predicted == marks[r.doc_id][1] for r in held]) > 0.99
    assert len(out) == len(rows) + len(extra) and [r.predicted for r in out if r.doc_id is None] == [1]
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    terms = toxicity.Terms(model.bits, model.places)
    one, two = (terms[w] for w in (b"rotten", b"foreigners"))
    assert sum(float(model.vectors[i] @ model.vectors[j]) for i in one for j in two) > 1
