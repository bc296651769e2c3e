"""The ten operators on small tables: edge cases, brute force, held-out accuracy."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weirgate.llm import blocks, embedding_dedup, jaccard_join, language_id, quality, substring_dedup, tokens, toxicity
from weirgate.llm.common import Scratch
from weirgate.llm.decontamination import mark_contamination
from weirgate.llm.embedding_dedup import near_vectors
from weirgate.llm.graph import components
from weirgate.llm.jaccard_join import near_duplicates
from weirgate.llm.line_dedup import dedup_lines
from weirgate.llm.mixing import mix_sources
from weirgate.llm.substring_dedup import chains, common_words, repeated_passages, segments
from weirgate.llm.url_filter import filter_captures, intervals

DOCS = "doc_id long, text string, lang string, source string, row string, n_dropped int"
WORDS = [f"w{i}" for i in range(400)]


def docs_of(spark, texts, source="s"):
    """Documents with an extra column of a name that the operators use themselves."""
    return spark.createDataFrame([(i, t, None, source, "own", -1) for i, t in texts], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [(None, "a b c d e f"), (90, None), (91, ""), (92, " \t\n"), (93, "Ä ö ß"), (94, "same same"), (94, "same same")]


def test_tokens_in_pieces(monkeypatch):
    texts = ["Ab c", None, "", "xYz" * 50 + " q", "ü1-2"]
    whole = tokens.words(pa.array(texts), tokens.ALNUM)
    monkeypatch.setattr(tokens, "SLICE", 160)
    for got, want in zip(tokens.words(pa.array(texts), tokens.ALNUM), whole, strict=True):
        assert (got == want).all()
    assert np.diff(whole[1]).tolist() == [2, 0, 0, 2, 2]
    assert tokens.words(pa.array(["AB", "ab"]), tokens.ALNUM)[0][0] == tokens.words(pa.array(["ab"]), tokens.ALNUM)[0][0]


def test_words_longer_than_a_slice(monkeypatch):
    long = ["ab" * 80, "c" * 500 + " d", "e " + "Fg" * 400, "h" * 159 + " " + "i" * 321 + "  j", "", "k" * 160 + "l" * 160]
    whole = tokens.words(pa.array(long), tokens.NOT_BLANK)
    monkeypatch.setattr(tokens, "SLICE", 160)
    for got, want in zip(tokens.words(pa.array(long), tokens.NOT_BLANK), whole, strict=True):
        assert got.tolist() == want.tolist()
    assert np.diff(whole[1]).tolist() == [1, 2, 2, 3, 0, 1]


def test_line_dedup(spark):
    texts = [(i, f"Hot line\nown {i}\n\n hot LINE \nend {i}") for i in range(10)] + ODD
    out = {(r.doc_id, r.text): r for r in dedup_lines(docs_of(spark, texts)).collect()}
    r = out[3, "own 3\n\nend 3"]
    assert (r.n_lines, r.n_dropped, r.row) == (5, 2, "own")
    assert out[90, ""].n_lines == 1 and out[91, ""].n_dropped == 0 and out[None, "a b c d e f"].n_lines == 1
    assert dedup_lines(docs_of(spark, texts)).count() == len(texts)
    assert dedup_lines(docs_of(spark, [])).count() == 0


def brute_components(texts, k=5):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[i]] == label[i] for i in label):
            break
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for base in range(6):
        words = prose(rng, 60).split()
        for _ in range(6):
            own = words[:]
            for _ in range(rng.randrange(3)):
                own[rng.randrange(60)] = rng.choice(WORDS)
            texts.append((len(texts), " ".join(own).upper() if rng.random() < 0.3 else " ".join(own)))
    texts += [(50, "one two"), (51, "ONE two"), (52, ""), (53, None), (54, "one two three four five")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs_of(spark, texts)).collect()}
    assert got == brute_components(texts)
    odd = near_duplicates(docs_of(spark, ODD)).collect()
    assert len(odd) == len(ODD) and next(r for r in odd if r.doc_id is None).component_id is None
    assert near_duplicates(docs_of(spark, [])).count() == 0


def test_jaccard_join_in_small_blocks(spark, monkeypatch):
    """Large groups whose members differ from each other about as much as links allow, in many blocks and several rounds."""
    for name, value in {"LONG_COLUMN": 2, "ROUNDS": 2, "PARTS": 3}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(blocks, "BLOCK_ENTRIES", 500)
    monkeypatch.setattr(blocks, "PACK_ENTRIES", 300)
    rng = random.Random(11)
    texts, footer = [], prose(rng, 60)
    for base in range(3):
        words = prose(rng, 90).split()
        for _ in range(40):
            own = words[:]
            for _ in range(rng.randrange(6)):
                own[rng.randrange(90)] = f"own{rng.randrange(10**6)}"
            texts.append((len(texts) * 7 % 1000, " ".join(own)))
    texts += [(2000 + i, f"{footer} {prose(rng, rng.randrange(8, 60))}") for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs_of(spark, texts).repartition(5)).collect()}
    want = brute_components(texts)
    assert got == want and len({c for _, c in want.values()}) > 10


def test_blocks_hold_all_entries(monkeypatch):
    monkeypatch.setattr(blocks, "PACK_ENTRIES", 50)
    rng = np.random.default_rng(5)
    column, doc = rng.integers(0, 2**64, 400, dtype=np.uint64), np.sort(rng.integers(0, 30, 400)) * 1_000_003 - 5
    parts = [(column[a : a + 40], doc[a : a + 40], np.arange(a, a + 40)) for a in range(0, 400, 40)]
    rows = pa.Table.from_batches(blocks.packed(parts, 7))
    got = []
    for b in range(7):
        c, ids, place = blocks.unpacked(rows.filter(pa.compute.equal(rows["block"], b)))
        assert (np.diff(c.astype(float)) >= 0).all()
        got += zip(c.tolist(), ids.tolist(), place.tolist(), strict=True)
    assert sorted(got) == sorted(zip(column.tolist(), doc.tolist(), range(400), strict=True))


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 7), (5, 5), (7, 20), (20, 21), (21, 0)], "a long, b long")
    got = {r.id: r.component for r in components(links, Scratch(spark, "test")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 7: 0, 20: 0, 21: 0, 8: 8, 9: 8}


def test_chains_prefer_ordered_matches():
    pos = np.array([0, 5, 10, 30, 35, 100])
    got = chains(segments(pos, pos + np.array([7, 7, 7, 9, 9, -90])), 20)
    assert [s[:2].tolist() for s in got[0]] == [[0, 18], [30, 43]]
    assert common_words([1, 2, 3, 4], [2, 9, 3]) == 2


def longest(x, y):
    """Lengths of the longest common subsequences of all beginnings, by the table."""
    t = np.zeros((len(x) + 1, len(y) + 1), int)
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            t[i, j] = t[i - 1, j - 1] + 1 if a == b else max(t[i - 1, j], t[i, j - 1])
    return t


def test_alignment_against_the_table():
    rng = random.Random(21)
    for _ in range(300):
        x, y = ([rng.randrange(rng.choice([3, 8, 30])) for _ in range(rng.randrange(30))] for _ in range(2))
        if rng.random() < 0.5:
            y = [w for w in x if rng.random() < 0.8] + y[:5]
        t = longest(x, y)
        assert common_words(x, y) == t[-1, -1]
        i, j, n = substring_dedup._extension(x, y)
        score = t - 0.5 * np.maximum(np.arange(len(x) + 1)[:, None], np.arange(len(y) + 1)[None])
        assert t[i, j] == n and n - 0.5 * max(i, j) == max(0, score.max())


def test_chains_against_all_predecessors():
    """The Fenwick tree gives the worth of the best chain, as trying all predecessors does."""
    rng = random.Random(22)
    for _ in range(60):
        segs = []
        for _ in range(rng.randrange(1, 25)):
            a, b, n = rng.randrange(120), rng.randrange(120), rng.randrange(4, 20)
            segs.append([a, a + n, b, b + n])
        segs = np.array(sorted(segs))
        worth = []
        for i, (a, b, c, _) in enumerate(segs):
            gains = [worth[j] - substring_dedup.GAP_COST * (a - segs[j][1] + c - segs[j][3]) for j in range(i) if segs[j][1] <= a and segs[j][3] <= c]
            worth.append(b - a + max([0, *gains]))
        best = chains(segs, 4)[0]
        got = sum(best[:, 1] - best[:, 0]) - substring_dedup.GAP_COST * sum((best[1:, 0] - best[:-1, 1]) + (best[1:, 2] - best[:-1, 3]))
        assert got == pytest.approx(max(worth))


def test_repeated_passages(spark):
    rng = random.Random(2)
    passage = prose(rng, 80).split()
    fuzzy = passage[:]
    fuzzy[25] = "edited"
    del fuzzy[55]
    texts = [(1, f"{prose(rng, 30)} {' '.join(passage)} {prose(rng, 40)}"), (2, f"{prose(rng, 90)} {' '.join(fuzzy)}"), (3, prose(rng, 200)), (4, " ".join(passage)), *ODD]
    got = {(r.doc_id, r.other_id): r for r in repeated_passages(docs_of(spark, texts)).collect()}
    assert set(got) == {(2, 1), (4, 1)}
    assert (got[4, 1].start, got[4, 1].end, got[4, 1].other_start, got[4, 1].matched) == (0, 80, 30, 80)
    assert got[2, 1].matched >= 75 and abs(got[2, 1].start - 90) <= 2 and got[2, 1].identity > 0.9
    assert repeated_passages(docs_of(spark, [])).count() == 0


def edited(rng, passage, every):
    """The passage with one word replaced at even spacing, from a random place on."""
    at = rng.randrange(every)
    return [rng.choice(WORDS) + "x" if i % every == at else w for i, w in enumerate(passage)]


def test_edited_passages_against_brute_force(spark):
    rng = random.Random(5)
    kinds = [(60, 20), (60, 10), (80, 14), (120, 10), (60, 7), (120, 5)]
    texts, wanted = [], defaultdict(list)
    for kind in kinds:
        for _ in range(30):
            one = prose(rng, kind[0]).split()
            two = edited(rng, one, kind[1])
            i, common = len(texts), common_words([hash(w) for w in one], [hash(w) for w in two])
            assert common >= 40 and common >= 0.7 * kind[0]
            texts += [(1000 + i, f"{prose(rng, 50)} {' '.join(one)} {prose(rng, 50)}"), (1001 + i, f"{prose(rng, 20)} {' '.join(two)} {prose(rng, 70)}")]
            wanted[kind].append((1001 + i, 1000 + i))
    got = {(r.doc_id, r.other_id): r for r in repeated_passages(docs_of(spark, texts)).collect()}
    recall = {k: np.mean([p in got for p in pairs]) for k, pairs in wanted.items()}
    assert set(got) <= {p for pairs in wanted.values() for p in pairs}
    assert all(recall[k] == 1 for k in kinds[:4]) and recall[60, 7] >= 0.9 and recall[120, 5] >= 0.7, recall
    assert all(abs(got[p].start - 20) <= 4 and abs(got[p].end - 80) <= 4 for p in wanted[60, 10])


def test_passages_composed_of_other_documents(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_DOCS", 32)
    rng = random.Random(7)
    texts, wanted = [], set()
    for case in range(10):
        parts, base = [prose(rng, 20) for _ in range(3)], 100 * case
        texts += [(base + i, f"{prose(rng, 30)} {part} {prose(rng, 30)}") for i, part in enumerate(parts)]
        # the previous document of each stretch is another one again
        texts += [(base + 10, f"{prose(rng, 10)} {' '.join(parts)} {prose(rng, 10)}"), (base + 20, f"{prose(rng, 25)} {' '.join(parts)} {prose(rng, 5)}")]
        texts += [(base + 12 + i, f"{prose(rng, 8)} {part} {prose(rng, 8)}") for i, part in enumerate(parts)]
        wanted.add((base + 20, base + 10))
    # stretches so frequent that their seeds are hot
    hot = [prose(rng, 20) for _ in range(3)]
    texts += [(5000 + i, f"{prose(rng, 10)} {hot[i % 3]} {prose(rng, 10)}") for i in range(150)]
    texts += [(6000 + i, f"{prose(rng, 10)} {' '.join(hot)} {prose(rng, 10)}") for i in range(6)]
    got = {(r.doc_id, r.other_id): r for r in repeated_passages(docs_of(spark, texts).repartition(1)).collect()}
    assert wanted <= set(got) and all(got[p].matched >= 60 for p in wanted)
    assert {i for i, _ in got if i >= 5000} == set(range(6001, 6006))


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base + 0.15 * rng.standard_normal((40, 16)), np.repeat(base[:1], 30, 0) + 0.05 * rng.standard_normal((30, 16))])
    rows = [(i, v.tolist(), i % 2, 7) for i, v in enumerate(x)] + [(200, None, 0, 7), (201, [0.0] * 16, 0, 7), (202, [float("nan")] * 16, 0, 7), (203, x[0].tolist(), None, 7), (204, [], 0, 7), (205, [None] * 16, 0, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    assert len(got) == len(rows) and all(got[i].n_links == 0 and got[i].kept for i in range(200, 206))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.93) & ~np.eye(len(x), dtype=bool) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None] % 2)
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.9 * want.sum() <= found <= want.sum() and all(got[i].n_links <= want[i].sum() for i in range(len(x)))


def test_embeddings_in_small_blocks(spark, monkeypatch):
    """Copies are counted by classes, buckets are compared in blocks, chains of links keep their components."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((5, 24))
    x = np.concatenate([np.repeat(base, 12, 0) + 0.1 * rng.standard_normal((60, 24)), np.repeat(base[:2] * 3.0, 20, 0), rng.standard_normal((40, 24))])
    label = np.concatenate([np.zeros(60, int), np.zeros(40, int), rng.integers(0, 2, 40)])
    df = spark.createDataFrame([(1000 - i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {1000 - r.vec_id: r for r in near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.93) & ~np.eye(len(x), dtype=bool) & (label[:, None] == label[None])
    assert sum(r.n_links for r in got.values()) >= 0.98 * want.sum() and all(got[i].n_links <= want[i].sum() for i in got)
    copies = [i for i in range(60, 80)]
    assert len({got[i].component_id for i in copies}) == 1 and all(got[i].n_links >= 19 for i in copies) and sum(got[i].kept for i in copies) <= 1
    # repeated rows, rows without id, no rows
    odd = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [2.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    out = near_vectors(odd).collect()
    assert len(out) == 5 and {(r.vec_id, r.n_links, r.component_id, r.kept) for r in out} == {(1, 2, 1, True), (None, 0, None, True), (3, 2, 1, False), (4, 2, 1, False)}
    assert near_vectors(odd.limit(0)).count() == 0


def test_embedding_recall(spark):
    """Pairs at and just above the threshold, of 64 dimensions."""
    rng = np.random.default_rng(10)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal((1500, 64))
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = rng.uniform(0.9301, 0.96, 1500)[:, None]
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * side])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = near_vectors(df).where("n_links > 0").count() / 3000
    assert 0.97 < found <= 1.0, found


def brute_hits(doc, items, window=10):
    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, who = cut(doc), set(), set()
    for i, t in items:
        v = cut(t)
        n = min(window, len(v))
        for g in {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else ():
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) == g:
                    hit |= set(range(p, p + n))
                    who.add(i)
    return len(w), len(hit), sorted(who)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate([30, 12, 10, 9, 5, 1, 14])] + [(7, None), (8, "!!"), (9, "same ANSWER")]
    texts = []
    for i in range(25):
        parts = [prose(rng, rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items[:7])[1].split()
            a = rng.randrange(len(w))
            parts += [" ".join(w[a : a + rng.randrange(8, 25)]).upper(), prose(rng, 5)]
        texts.append((i, ", ".join(parts)))
    texts += [*ODD[:5], (60, "the Same answer, yes")]
    out = mark_contamination(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in out}
    assert got == {i: brute_hits(t, items) for i, t in texts} and got[60][2] == [9]
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in out)
    assert mark_contamination(docs_of(spark, texts), spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


def reshared(sizes, weights, total):
    """Targets by capping and resharing the excess again and again."""
    target, capped = {s: 0.0 for s in sizes}, set()
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        for s in free:
            target[s] = rest * weights[s] / sum(weights[x] for x in free)
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return {s: 2 * sizes[s] if s in capped else target[s] for s in sizes}
        capped |= set(over)


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(30)), None, rng.choice(["b", "a", None, "c"]) if i > 150 else "hot", "own", 0) for i in range(300)] + [(7, None, None, "a", "own", 0), (8, "x y", None, "b", "own", 0), (8, "x y", None, "b", "own", 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = mix_sources(df).collect()
    assert len(out) == 2 * len(rows)
    sizes, taken, per = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    for r in out:
        taken[r.source] += r.words
        per[r.doc_id, r.nth] += r.words
        assert 0 <= r.words <= r["size"] and r.row == "own"
    order = sorted(s for s in sizes if s) + [None]
    want = reshared(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for r in out:
        assert r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) < 30 for s in sizes) and sum(taken.values()) == 3 * sum(sizes.values()) // 2
    # the merged queue decides: whatever is taken ends before whatever isn't, in any source
    done = [r.finish for r in out if r.words == r["size"] > 0]
    assert max(done) <= min(r.finish for r in out if r["size"] > r.words) and sum(0 < r.words < r["size"] for r in out) <= 1
    assert any(abs(taken[s] - want[s]) > 1 for s in sizes)
    assert sorted(map(str, mix_sources(df.repartition(3)).collect())) == sorted(map(str, out))
    assert mix_sources(df.limit(0)).count() == 0


def test_url_filter(spark):
    entries = spark.createDataFrame([("bad.org", "2024-01-05", True), ("bad.org", "2024-02-05", False), ("bad.org", "2024-02-05", True), ("BAD.org", "2024-06-01", False), ("x.bad.org", "2024-03-01", True), (None, "2024-01-01", True)], "domain string, day string, listed boolean").selectExpr("domain", "cast(day as date) day", "listed")
    assert [(str(r.listed_from), str(r.listed_until)) for r in intervals(entries).where("domain = 'bad.org'").collect()] == [("2024-01-05", "2024-06-01")]
    rows = [(1, "http://www.BAD.org:80/p", "2024-01-05"), (2, "http://bad.org", "2024-06-01"), (3, "https://u@a.x.bad.org/#t", "2024-04-01"), (4, "http://notbad.org", "2024-04-01"), (5, None, "2024-04-01"), (6, "http://bad.org", None)]
    captures = spark.createDataFrame(rows, "page_id long, url string, f string").selectExpr("page_id", "url", "cast(f as date) fetched", "'own' as host")
    got = {r.page_id: r.domain for r in filter_captures(captures, entries).collect()}
    assert got == {1: "bad.org", 2: None, 3: "x.bad.org", 4: None, 5: None, 6: None}
    assert filter_captures(captures.limit(0), entries).count() == 0


def test_url_filter_of_many_labels(spark):
    deep = ".".join(["a"] * 12) + ".bad.org"
    entries = spark.createDataFrame([(deep, "2024-01-05", True)], "domain string, day string, listed boolean").selectExpr("domain", "cast(day as date) day", "listed")
    rows = [(1, f"http://{deep}/p"), (2, f"http://x.{deep}/"), (3, "http://bad.org/")]
    captures = spark.createDataFrame(rows, "page_id long, url string").selectExpr("page_id", "url", "date'2024-02-01' as fetched")
    assert {r.page_id: r.domain for r in filter_captures(captures, entries).collect()} == {1: deep, 2: deep, 3: None}


def test_factorization_machine_learns_pairs():
    rng = random.Random(0)
    texts, y = [], []
    for _ in range(1200):
        w, a, b = [rng.choice(WORDS[:40]) for _ in range(8)], rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(w + ["insult"] * a + ["group"] * b))
        y.append(float(a and b))
    text, bucket = toxicity.terms(pa.array(texts[:1000]))
    model = toxicity.fit(text, bucket, np.array(y[:1000]))
    scores = model.scores(pa.array(texts[1000:]))
    assert ((scores >= 0.5) == np.array(y[1000:], bool)).mean() > 0.95
    assert len(model.scores(pa.array([None, ""]))) == 2


def test_pairs_of_terms_that_say_nothing_alone():
    rng = random.Random(3)
    texts, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([rng.choice(WORDS[:60]) for _ in range(8)] + ["one"] * a + ["two"] * b))
        y.append(float(a != b))
    y = np.array(y)
    text, bucket = toxicity.terms(pa.array(texts[:2500]))
    model = toxicity.fit(text, bucket, y[:2500])
    assert ((model.scores(pa.array(texts[2500:])) >= 0.5) == (y[2500:] > 0)).mean() > 0.95
    model.v[:] = 0  # the weights alone can give any-of-two at best
    assert ((model.scores(pa.array(texts[2500:])) >= 0.5) == (y[2500:] > 0)).mean() < 0.8


def test_factorization_machine_against_the_double_loop():
    rng = np.random.default_rng(2)
    m = toxicity.FactorizationMachine(np.arange(6), 0.3, rng.standard_normal(6), rng.standard_normal((6, 4)))
    has = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5]]
    want = [0.3 + sum(m.w[i] for i in x) + sum(m.v[i] @ m.v[j] for i in x for j in x if i < j) for x in has]
    got = m.logits(np.repeat(np.arange(4), [len(x) for x in has]), np.array(sum(has, [])), 4)
    assert np.allclose(got, want)


def test_toxicity_of_long_and_repeated_texts(spark):
    rng = random.Random(4)
    texts = [(i, prose(rng, 20) + (" insult" if i % 4 == 0 else "")) for i in range(200)]
    df = spark.createDataFrame([(i, t, "kept") for i, t in [*texts, (900, "word " * 200_000 + "insult"), (0, texts[0][1])]], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(200)] + [(0, 0, "y")], "doc_id long, label int, text string")
    out = toxicity.score_toxicity(df, toxicity.learn(df, labels))
    assert out.columns == ["doc_id", "text", "score"] and out.count() == 202 and out.where("doc_id = 900 AND score >= 0.5").count() == 1


def test_toxicity_operator(spark):
    rng = random.Random(1)
    texts = [(i, prose(rng, 20) + (" insult" if i % 4 == 0 else "")) for i in range(300)]
    df = docs_of(spark, texts + ODD[1:3])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(5, None)], "doc_id long, label int")
    out = toxicity.score_toxicity(df, toxicity.learn(df, labels)).where("doc_id >= 200 OR doc_id IN (90, 91)").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in out if r.doc_id >= 200)
    assert {0 <= r.score <= 1 for r in out} == {True}
    none = toxicity.learn(df, labels.limit(0))
    assert toxicity.score_toxicity(df, none).count() == df.count()


def test_ordinal_regression():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 5))
    z = x @ np.array([2.0, -1, 0, 0, 1]) + rng.logistic(size=600) * 0.3
    y = (z > -1).astype(int) + (z > 1)
    m = quality.fit(x[:500], y[:500], [0, 1, 2])
    assert m.theta[0] < m.theta[1]
    tails = m.tails(x[500:])
    assert (tails[:, 0] >= tails[:, 1]).all() and np.corrcoef(m.expected(tails), y[500:])[0, 1] > 0.85


def test_ordinal_fit_is_a_maximum():
    """At the fitted values, the penalised likelihood falls whichever way a parameter is moved."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 4))
    z = x @ np.array([1.0, -0.5, 0.0, 0.3]) + rng.logistic(size=400)
    y = (z > -1).astype(int) + (z > 0.5) + (z > 1.5)
    m = quality.fit(x, y, [0, 1, 2, 3])

    def value(w, theta):
        tails = 1 / (1 + np.exp(-((x @ w)[:, None] - theta[None])))
        full = np.concatenate([np.ones((400, 1)), tails, np.zeros((400, 1))], 1)
        return np.log(full[np.arange(400), y] - full[np.arange(400), y + 1]).mean() - quality.L2 * (w @ w) / 2

    both = np.concatenate([m.w, m.theta])
    for i in range(len(both)):
        step = np.eye(len(both))[i] * 1e-4
        slope = (value(*np.split(both + step, [4])) - value(*np.split(both - step, [4]))) / 2e-4
        assert abs(slope) < 2e-3
    assert (np.diff(m.theta) > 0).all()


def test_recurrent_gradient_against_finite_differences():
    rng = np.random.default_rng(7)
    hidden, times, lanes = 3, 6, 4
    d = {"x": rng.normal(0, 0.5, (2 * hidden, language_id.PAD + 1)).astype(np.float32), "u": rng.normal(0, 0.5, (2 * hidden, hidden)).astype(np.float32)}
    steps = rng.integers(0, 5, (times, lanes))
    steps[4:, 0] = language_id.PAD  # a text that ends before
    weight = rng.standard_normal((times, hidden, lanes)).astype(np.float32)
    states, saved = language_id._states(d, steps, True)
    grads = dict(zip(("x", "u"), language_id._gradient(d, steps, saved, weight), strict=True))
    assert (states[4:, :, 0] == states[3, :, 0]).all() and (grads["x"][:, language_id.PAD] == 0).all()

    def loss():
        return float((language_id._states(d, steps, False)[0].astype(np.float64) * weight).sum())

    for name in d:
        for _ in range(25):
            i, j = rng.integers(0, d[name].shape[0]), rng.integers(0, 5 if name == "x" else hidden)
            kept = d[name][i, j]
            d[name][i, j] = kept + 0.01
            up = loss()
            d[name][i, j] = kept - 0.01
            slope = (up - loss()) / 0.02
            d[name][i, j] = kept
            assert slope == pytest.approx(grads[name][i, j], rel=0.03, abs=5e-3)


def test_odd_rows_of_models(spark):
    """Clashing columns, repeated rows, very long texts, labels that tie."""
    rng = random.Random(8)
    texts = [(i, prose(rng, 20), "aa" if i % 2 else "bb", "own", -1.0) for i in range(40)] + [(3, prose(rng, 5), "aa", "own", -1.0)] * 2 + [(90, "word " * 150_000, None, "own", -1.0), (91, None, None, "own", -1.0)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, lang_pred string, expected_grade double")
    out = language_id.identify(df, language_id.learn(df.where("doc_id < 90")))
    assert out.count() == len(texts) and set(df.columns) <= set(out.columns) and out.where("lang_pred NOT IN ('aa', 'bb', 'und')").count() == 0
    model = quality.learn(df, spark.createDataFrame([(i, i % 3) for i in range(40)] + [(3, 2), (None, 1)], "doc_id long, grade int"))
    assert quality.score_quality(df, model).count() == len(texts)


def test_quality_operator(spark):
    rng = random.Random(1)
    texts = [(i, prose(rng, 30) if i % 2 else "*** $$$ " * 20) for i in range(120)]
    df = docs_of(spark, texts + ODD[1:4])
    ratings = spark.createDataFrame([(i, (i % 2) * 2) for i in range(80)], "doc_id long, grade int")
    out = quality.score_quality(df, quality.learn(df, ratings)).collect()
    assert all(r.selected == (r.doc_id % 2 == 1) for r in out if 80 <= r.doc_id < 90 or 95 < r.doc_id) and len(out) == 123
    assert quality.score_quality(df, None).where("selected").count() == 0


def test_language_id(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 120)
    rng = random.Random(1)
    words = {"aa": ["the", "of", "and", "then", "that"], "bb": ["que", "ción", "los", "ñar", "para"]}
    texts = [(i, " ".join(rng.choice(words["aa" if i % 2 else "bb"]) for _ in range(rng.randrange(5, 60))), "aa" if i % 2 else "bb") for i in range(200)]
    df = spark.createDataFrame([*texts, (500, None, "aa"), (501, "", None), (502, "12 34 !", "aa"), (503, "the of " * 30_000, None)], "doc_id long, text string, lang string")
    net = language_id.learn(df.where("doc_id < 120"))
    got = {r.doc_id: r for r in language_id.identify(df, net).collect()}
    held = [i for i in range(120, 200)]
    assert np.mean([got[i].lang_pred == ("aa" if i % 2 else "bb") for i in held]) > 0.95
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[503].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.learn(df.limit(0)) is None and {r.lang_pred for r in language_id.identify(df, None).collect()} == {"und"}
