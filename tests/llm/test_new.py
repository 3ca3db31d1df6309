"""Conversation repair, packing and the prefix trie against brute force; secrets in long candidates."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lociflow.llm import common, packing, pieces, prefixes, pst, secrets, structure

DATA = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
TEXTS = ["a.", "b!", "c", "", " ", "\n\t", "ok? ", "fin. \n", "x y z.", None]
ROLES = [None, "user", "assistant", "system", "tool", "", "usher"]


def some_turns(seed, n=700):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, -5, -20, *range(60)]), rnd.choice([None, *range(12)]), rnd.choice(ROLES), rnd.choice(TEXTS)) for _ in range(n)]
    return rows + [(c, k if k > 40 else None, rnd.choice(ROLES[1:4]), rnd.choice([*TEXTS, *(f"t{k}." for _ in range(30))])) for c in (1000, 1001) for k in range(300)]


def sorted_turns(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    """By Dijkstra over (turns read, state), paths compared by (cost, audit)."""
    steps = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    whole, out = defaultdict(list), {}
    for c, *turn in plain_damage(rows):
        whole[c].append(turn)
    for c in {r[0] for r in rows}:
        turns = sorted_turns(whole[c])
        numbers, seen, faults = [t[0] for t in turns if t[0] is not None], set(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        queue, done = [(0, "", 0, "E", ())], set()
        while True:
            cost, audit, k, state, lines = heapq.heappop(queue)
            if k == len(turns) and state in "EA":
                break
            if (k, state) in done:
                continue
            done.add((k, state))
            roles = [(r[0], r) for r in ("user", "assistant") if (state, r[0]) in steps]
            for letter, role in roles:
                heapq.heappush(queue, (cost + 3, audit + "I", k, steps[state, letter], (*lines, f"{role}:")))
            if k < len(turns):
                _, own, text = turns[k]
                heapq.heappush(queue, (cost + 4, audit + "D", k + 1, state, lines))
                more = 3 if faults[k] == "t" else 0
                if faults[k] not in ("b", "d"):
                    if (state, own[:1]) in steps:
                        heapq.heappush(queue, (cost + more, audit + "K", k + 1, steps[state, own[:1]], (*lines, f"{own}:{text}")))
                    for letter, role in roles:
                        heapq.heappush(queue, (cost + 3 + more, audit + "R", k + 1, steps[state, letter], (*lines, f"{role}:{text}")))
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[c] = (gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("segment", [1000, 7])
def test_structure(spark, segment):
    rows = some_turns(1)
    turns = spark.createDataFrame([(*r, 7) for r in rows], TURNS + ", cost int").repartition(5)
    found = structure.of_all(turns, *structure.repair(structure.damaged(turns), segment)).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == plain_repair(rows)


def test_structure_at_the_edges(spark):
    none = spark.createDataFrame([], TURNS)
    assert structure.of_all(none, *structure.repair(none)).count() == 0
    long = "x" * 300_000 + "."
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", long), (2, 0, "", "a."), (3, 0, "assistant", None)], TURNS)
    report, repaired = structure.repair(turns)
    assert {r.conv_id: (r.cost, r.audit, r.duplicate, r.blank) for r in report.collect()} == {1: (4, "KKD", 1, 0), 2: (4, "D", 0, 0), 3: (4, "D", 0, 1)}
    kept = repaired.where("edit != 'D'").orderBy("conv_id", "segment", "n").collect()
    assert [(r.edit, r.role, len(r.text)) for r in kept] == [("K", "user", 300_001), ("K", "assistant", 300_001)]


def test_grammar():
    g = structure.Grammar()
    for text, ok in (("", True), ("s", False), ("ua", True), ("sua", True), ("suaua", True), ("uau", False)):
        stack = (0, None)
        for c in text:
            stack = g.shift(stack, c)
        assert g.accepts(stack) is ok
    with pytest.raises(ValueError):
        structure.Grammar((("D", "uDa"), ("D", "")))



def test_subset():
    rnd = random.Random(2)
    for _ in range(200):
        counts = {rnd.randint(1, 12): rnd.randint(1, 3) for _ in range(rnd.randint(1, 4))}
        room = rnd.randint(1, 25)
        best = {0}
        for n, c in counts.items():
            best = {s + k * n for s in best for k in range(c + 1) if s + k * n <= room}
        used = packing.subset(counts, room)
        assert sum(n * c for n, c in used.items()) == max(best) and all(c <= counts[n] for n, c in used.items())


@pytest.mark.parametrize("lengths", [[600] * 50, [1], [], [1023, 1], *([random.Random(k).randint(1, 1023) for _ in range(300)] for k in range(3))])
def test_windows_are_filled(lengths):
    found = list(packing.filled([(k, 5, n) for k, n in enumerate(lengths)]))
    sizes = [sum(n for *_, n in s) for s in found]
    assert sum(sizes) == sum(lengths) and all(n == 1024 or n & (n - 1) == 0 for n in sizes) and sum(n < 1024 for n in sizes) <= 10
    places = defaultdict(list)
    for s in found:
        for key, start, n in s:
            places[key].append((start, n))
    for k, n in enumerate(lengths):
        at = 5
        for start, size in sorted(places[k]):
            assert start == at and size > 0
            at += size
        assert at == n + 5


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    odd = ["", None, " " * 5000, "ab<|endoftext|>c", "é́ 中文 \U0001f600", "word " * 40_000, "x" * 3000, "\r\n\t a'll  b "]
    texts = odd + ["".join(rnd.choice(["the ", "of\n", "Zü", "12 ", "..", " q"]) for _ in range(rnd.randint(0, 900))) for _ in range(60)]
    docs = spark.createDataFrame([(k if k != 3 else None, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, length string").repartition(3)
    rows = packing.pack(docs, group=4000).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for k, text in enumerate(texts):
        of = sorted(pieces[k if k != 3 else None], key=lambda r: r.start)
        want = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(b"".join(r.ids for r in of), "<u4").tolist() == want and {r.doc_tokens for r in of} == {len(want)}
        assert [r.start for r in of] == [sum(x.length for x in of[:i]) for i in range(len(of))]
    for of in sequences.values():
        of.sort(key=lambda r: r.offset)
        assert [r.offset for r in of] == [sum(x.length for x in of[:i]) for i in range(len(of))]
        size = sum(r.length for r in of)
        assert size == 1024 or size < 1024 and size & (size - 1) == 0
    assert packing.pack(docs.limit(0)).count() == 0
    assert sorted(r[:] for r in packing.pack(docs, group=4000).collect()) == sorted(r[:] for r in rows) if None not in pieces else True


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t, role, text))
    turns = {c: [(r[1] or "", r[2] or "") for r in sorted_turns([(t, role or "", text or "") for t, role, text in x])] for c, x in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = turns.get(base, [])[:h] + own[h:]
    members, children = defaultdict(list), Counter()
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        saved[p] += (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = {p: ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


@pytest.mark.parametrize("forced", [False, True])
def test_trie(spark, monkeypatch, forced):
    if forced:  # blocks, runs of ids, a full sketch and shuffled joins
        for module, name, value in ((prefixes, "WIDTH", 16), (prefixes, "RUN", 50), (prefixes, "GREATEST", 1 << 16), (prefixes, "ROOMY", 1), (common, "BROADCAST_ROWS", 1)):
            monkeypatch.setattr(module, name, value)
    rows = some_turns(6) + [(2000 + k, n, "user", f"same {n}") for k in range(40) for n in range(30)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], TURNS + ", depth int").repartition(5)
    found = prefixes.trie(*prefixes.rebuilt(turns))
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in found.collect()) == plain_trie(rows)


def test_trie_below_proved_nodes(spark, monkeypatch):
    """A sketch so small that many nodes with one member aren't proved to have one, though the node above is."""
    for name, value in (("LEAST", 1 << 8), ("GREATEST", 1 << 10), ("SLICE", 1 << 8)):
        monkeypatch.setattr(prefixes, name, value)
    rnd = random.Random(11)
    rows = [(c, n, "user", rnd.choice(["a b", f"t{c} {n}"]) if n < 3 else f"own {c} {n}") for c in range(60) for n in range(rnd.randint(1, 9))]
    turns = prefixes.rebuilt(spark.createDataFrame(rows, TURNS).repartition(3))
    screened = prefixes.screened(common.stored(prefixes.digested(turns[0]), "test"))
    assert screened.where("up_alone AND NOT alone").count() > 0
    found = prefixes.trie(*turns)
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in found.collect()) == plain_trie(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefixes.trie(*prefixes.rebuilt(none)).count() == 0
    one = spark.createDataFrame([(None, 0, "user", "a"), (7, None, None, None)], TURNS)
    assert [tuple(r)[:7] for r in prefixes.trie(*prefixes.rebuilt(one)).orderBy("depth").collect()] == [tuple(r)[:7] for r in sorted(plain_trie([(7, None, None, None)]), key=lambda r: r[1])] or zlib.crc32(b"7") % 4 > 0


def test_screen_proves_singletons(spark):
    """No key that two conversations share is ever estimated at one."""
    rows = [(k // 2 if k < 4000 else k, 0, "user", f"t{k // 2 if k % 2 else k}") for k in range(6000)]
    turns, _ = prefixes.rebuilt(spark.createDataFrame(rows, TURNS))
    table = common.stored(prefixes.digested(turns), "test")
    counts = table.groupBy("key").agg(F.countDistinct("conv_id").alias("n"))
    seen = prefixes.screened(table).join(counts, "key")
    assert seen.where("alone AND n > 1").count() == 0 and seen.where("alone").count() > 0


def test_contexts_that_cannot_stay_are_not_asked_for():
    """Rare contexts of rare ones can't diverge by more than chance: no key is sent for them."""
    how = pst.Settings()
    rnd = random.Random(2)
    words = [" ".join(rnd.choice(["x y", "x z", "u", "a b c"]) for _ in range(60)) for _ in range(20)] + ["p q r s", "p q r s"] * 2
    batch = pa.record_batch({"doc_id": list(range(len(words))), "held_out": [False] * len(words), "text": words})
    block = pa.Table.from_batches(list(pst._block(iter([batch]), how.block))).append_column("block", pa.array([0]))
    model, answers = pst.Model(how, 1, 60), pst.ANSWER.empty_table()
    for lengths in (range(1, 3), range(3, how.depth + 2)):
        asked = pst._rows(pst.Block(block, answers, model).ask_counts(lengths), pst.ASK)
        found = pa.concat_tables([pst._answer(asked.filter(pc.equal(asked["kind"], k)), model) for k in lengths])
        answers = pa.concat_tables([answers, found.filter(pc.equal(found["block"], 0))])
        model = pst.Model(how, 1, 60, *(found[c].to_pylist()[1] for c in ("distinct", "total"))) if lengths.start == 1 else model
    at = pst.Block(block, answers, model)
    for length in range(1, how.depth + 2):
        at.sequences(length)
    for length in (2, 3):
        places, keys, which = at.contexts(length)
        of, shorter = at.counts[length][places - 1], at.counts[length - 1][places - 1]
        assert len(keys) and (2 * of * np.log(shorter / of) > 1 + how.sigmas * 2**0.5 - 0.01).all()
    asked = {r["kind"]: len(pst.unpacked(r["keys"], np.uint64)) for r in at.ask_tests()}
    assert all(asked[pst.CONTEXT + k] == len(at.contexts(k)[1]) < len(at.asked[k][1]) for k in (2, 3))


def test_tests_and_longest_sequences_that_no_other_block_needs():
    """Sequences of the greatest length are left out only where their context can't diverge enough. A block that has all
    that a context's counted successors can be tests it by itself, with the range's result; the range answers the rest."""
    how = pst.Settings()
    rnd = random.Random(5)
    names = [f"w{k}" for k in range(300)]
    texts = [" ".join(rnd.choices(names, [1 / (k + 1) for k in range(300)], k=80)) for _ in range(120)]
    texts = [" ".join([a, rnd.choice(texts)]) for a in texts]
    blocks = []
    for b in (0, 1):
        batch = pa.record_batch({"doc_id": list(range(60)), "held_out": [False] * 60, "text": texts[b::2]})
        blocks.append(pa.Table.from_batches(list(pst._block(iter([batch]), how.block))).append_column("block", pa.array([b])))
    model, answers = pst.Model(how, 2, 60, steps=1), pst.ANSWER.empty_table()
    at = lambda b: pst.Block(blocks[b], answers.filter(pc.equal(answers["block"], b)), model)
    for length in range(1, 6):
        asked = pa.concat_tables([pst._rows(at(b).ask_both(length), pst.ASK) for b in (0, 1)])
        answers = pa.concat_tables([answers, *(pst._answer(asked.filter(pc.equal(asked["part"], p)), model) for p in (0, 1))])
        if length == 1:
            found = answers.filter(pc.equal(answers["block"], -1))
            model = pst.Model(how, 2, 60, pc.sum(found["total"]).as_py(), pc.sum(found["distinct"]).as_py(), steps=1)
    lists = [[w.split() + [None] for w in texts[b::2]] for b in (0, 1)]
    counts = Counter(tuple(w[i : i + k]) for some in lists for w in some for k in range(1, 5) for i in range(len(w) - k + 1))
    limit, pruned = 1 + how.sigmas * 2**0.5, 0
    for b in (0, 1):
        one = at(b)
        for length in range(1, 5):
            one.sequences(length)
        seen = [tuple(w[max(0, i - 3) : i + 1]) for w in lists[b] for i in range(len(w))]
        for i, g in enumerate(seen):
            assert len(g) < 2 or one.counts[2][i] == (counts[g[-2:]] if counts[g[-2:]] >= 2 else 0)
            if len(g) == 4 and counts[g] >= 2:
                of, shorter = counts[g[:3]], counts[g[1:3]]
                assert one.counts[4][i] == counts[g] or (one.counts[4][i] == 0 and 2 * of * np.log(shorter / of) < limit)
                pruned += one.counts[4][i] == 0
    assert pruned > 0
    after = defaultdict(dict)
    for g, c in counts.items():
        if len(g) > 1 and c >= 2:
            after[g[:-1]][g[-1]] = c
    alone = needed = 0
    for b in (0, 1):
        one = at(b)
        for length in range(1, 5):
            one.sequences(length)
        seen = [tuple(w[max(0, i - 3) : i + 1]) for w in lists[b] for i in range(len(w))]
        for length in (1, 2, 3):
            places, mine, (needs, sent, answer, *_) = one.tests(length)
            answer[needs] = one.got[pst.CONTEXT + length]
            alone, needed = alone + (~sent & (answer > 0)).sum(), needed + needs.sum()
            for place, which in zip(places.tolist(), mine.tolist()):
                g = seen[place - 1][-length:]
                c, share = list(after[g].values()), [counts[*g[1:], w] / (counts[g[1:]] if length > 1 else model.n) for w in after[g]]
                gain = sum(x * np.log(x / counts[g] / q) for x, q in zip(c, share))
                left = counts[g] - sum(c)
                gain += left * np.log(left / counts[g] / max(1 - sum(share), 1e-12)) if left else 0
                assert answer[which] == (sum(c) + 1 if c and 2 * gain > len(c) + how.sigmas * np.sqrt(2 * len(c)) else 0)
    assert alone > 0 and needed > 0


def test_pieces_looks_up_beginnings_only(monkeypatch):
    """A start goes on only while its characters begin a piece, and a block's segmentations are those found one by one."""
    table = pieces.Pieces(pieces.Settings())
    table._lookup()
    rnd, keys = random.Random(3), []
    real = pieces.chain
    monkeypatch.setattr(pieces, "chain", lambda a, b: keys.append(a.size) or real(a, b))
    some = {pieces.SPACE + "".join(rnd.choice("abdeilnorstuzqé") for _ in range(11)) for _ in range(500)}
    table.learn(some)
    assert 0 < sum(keys) < 500 * 66 // 2  # all beginnings of 2 to 12 characters: 500 * 66
    alone = pieces.Pieces(pieces.Settings())
    assert all(table[c] == alone[c] for c in some)


def test_pieces_forget_between_tasks():
    how = pieces.Settings()
    batch = pa.record_batch({"doc_id": [1, 2], "text": ["some words here", None]})
    assert len(list(pieces._encode(iter([batch]), how))) == 1
    assert not pieces._pieces(how) and not pieces._pieces(how).few


def test_secrets_in_long_candidates(spark):
    long = ["a-" * 500_000 + "a1", "/a1" * 333_333, "Ab3/" * 250_000, "a_" * 500_000 + "1"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(long)], "doc_id long, text string").withColumn("n_hex", F.lit("clash"))
    assert [(r.n_hex, r.base_spans, r.entropy_spans) for r in secrets.scan(docs).collect()] == [(0, [], [])] * 4
    rnd = random.Random(5)
    made = ["".join(rnd.choice(["Ab", "a", "A", "12", "/", "_", "-", "=", "B2", "c", "+"]) for _ in range(rnd.randint(1, 9))) for _ in range(4000)]
    rows = spark.createDataFrame([(m,) for m in made], "m string").select("m", secrets.allowed(F.col("m")).alias("ok")).collect()
    assert [r.ok for r in rows] == [any(re.search(p, r.m) for p in secrets.ALLOW) for r in rows]


def test_mixing_of_alike_rows(spark):
    """Thousands of rows of one key: added up before ranges, cut once, and taken as far as their source's words go."""
    from lociflow.llm import mixing

    rows = [(k, f"w{k} x y", "a") for k in range(50)] + [(7, "one two three four", "b")] * 3000 + [(9, "p q", "b")] * 5 + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    found = mixing.mix(docs).collect()
    sums = Counter()
    for r in found:
        sums[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    targets = {r.source: r.target for r in found}
    assert len(found) == len(rows) and all(sums[s] == round(targets[s]) for s in targets)
    assert len({(r.taken, r.size) for r in found if r.source == "b" and r.size == 4}) <= 3


def test_neighbours_of_a_hot_cell(spark):
    """Most vectors in one cell: its blocks and its queries are joined block by block, and found as by brute force."""
    from lociflow.llm import ann

    rng = np.random.default_rng(3)
    near = np.concatenate([rng.normal(0, 1e-3, (9000, 8)) + 5.0, rng.normal(0, 1, (1000, 8))])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(near)], "vec_id long, embedding array<double>")
    found = ann.search(rows)
    import contextlib
    import io

    with contextlib.redirect_stdout(io.StringIO()) as plan:
        found.explain("formatted")
    assert re.search(r"Left keys \[2\]: \[cell#\d+, part#\d+L?\]", plan.getvalue()) or re.search(r"\[cell#\d+, part#\d+L?\], \[cell#\d+, part#\d+L?\]", plan.getvalue())
    got = defaultdict(set)
    for r in found.collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 10_000, 100):
        d = ((near - near[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits / 1000 >= 0.9


def test_a_query_is_sent_once_to_a_shard(spark):
    """And not once to each cell it visits, which at the default share are half of all: rows then grow with their product."""
    from lociflow.llm import ann

    x = np.random.default_rng(4).normal(size=(4000, 8))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert ann.search(rows, ann.Settings(every=4)).count() == 10_000
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last()
    values = dict(re.findall(r"(\d+) -> ([\d,]+)", store.executionMetrics(last.executionId()).toString()))
    nodes = store.planGraph(last.executionId()).allNodes()
    sent = [int(values[str(m.accumulatorId())].replace(",", "")) for n in map(nodes.apply, range(nodes.size())) if n.name() == "Generate" for m in map(n.metrics().apply, range(n.metrics().size())) if m.name() == "number of output rows"]
    assert sent and 1000 <= max(sent) <= 4000


def test_an_id_of_several_near_vectors_takes_one_rank(spark):
    from lociflow.llm import ann

    rows = [(0, [0.0, 1.0])] + [(1, [0.0, 1.0 + k / 64]) for k in range(1, 40)] + [(k, [0.0, 2.0 + k]) for k in range(2, 14)]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), ann.Settings(share=1.0)).collect()
    assert [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank)] == [(1, 1 / 64)] + [(k, k + 1.0) for k in range(2, 11)]


def test_the_reach_by_heap_and_by_sorting():
    from lociflow.llm import ann

    rng = np.random.default_rng(8)
    a, b, sizes = rng.random(9), rng.random(7), rng.integers(0, 5, 63) * 20
    for enough in (1, 20, int(sizes.sum()) // 60, int(sizes.sum()) // 3, int(sizes.sum()), 10**6):
        of = ann.cells_by_distance(a, b, sizes, enough)
        far = ann.reach(a, b, sizes, enough)
        assert {c for c in np.flatnonzero(sizes) if a[c // 7] + b[c % 7] <= far} == set(of)
