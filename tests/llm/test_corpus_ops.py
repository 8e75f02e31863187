"""Operators 1, 5, 6, 7, 9 and 10 against brute force, round trips and
held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from errata.llm import jaccard, mixing, packing, recount, sketches, tokens, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing names."""
    rows = [(None, "zz\nyy", "x", 1), (1, "a b c\nd", "x", 1), (1, "a b c\nd", "x", 1), (1, "other text", "y", 2), (3, None, None, None),
            (4, "", "y", 4), (5, "hello world " * 3000, "y", 5), (6, "x" * 30000, "é", 6), (7, "\n\n", "", 7), (9, "é𝒳 " * 400 + "\nq", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def plain_sets(rows):
    out = []
    for t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def plain_components(ids, sets):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return [min(groups[find(i)]) for i in range(len(ids))]


def near_copies():
    """Groups of near copies with chains, passages and one large group."""
    rng = random.Random(11)
    vocab = ["w%d" % i for i in range(3000)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    out = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 150]))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(" ".join(copy))
            if rng.random() < 0.3:
                out.append(out[-1].upper())
        out.append(passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 200))))
    base = [rng.choice(vocab) for _ in range(150)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(150)] = rng.choice(vocab)
        out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("star", [2, 16])
def test_jaccard_components(spark, documents, monkeypatch, star):
    monkeypatch.setattr(jaccard, "STAR_ROWS", star)
    rows = [(i, t) for i, t in enumerate(near_copies() + [None, "", "one", "ONE", "a b c d e"])]
    rows += [(1000 + r.doc_id, r.text) for r in documents.collect()] if star == 16 else []
    sets = plain_sets([t for _, t in rows])
    want = dict(zip([i for i, _ in rows], plain_components([i for i, _ in rows], sets)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for (i, _), s in zip(rows, sets)}


@pytest.mark.parametrize("block", [7, 1024])
def test_jaccard_counts_every_link(spark, monkeypatch, block):
    """Links within a large group of near copies too, and with repeated rows."""
    monkeypatch.setattr(jaccard, "STAR_ROWS", 4)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    texts = near_copies()
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, t) for i, t in enumerate(texts[:40])]
    sets = plain_sets([t for _, t in rows])
    links = {x: sum(x != y and 100 * len(x & y) >= 80 * len(x | y) for y in set(sets)) for x in set(sets)}
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == sorted((i, links[s]) for (i, _), s in zip(rows, sets))
    assert max(links.values()) > 4 * jaccard.STAR_PIVOTS


def test_jaccard_defined_cases(spark, odd):
    got = jaccard.jaccard_components(odd).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles) for r in got) == [(-1, 1), (1, 1), (1, 1), (1, 1), (3, 0), (4, 0), (5, 2), (6, 1), (7, 0), (9, 2)]
    assert jaccard.jaccard_components(odd.where("false")).count() == 0
    kept = jaccard.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == 9  # one of the repeated rows goes


def water_fill(sizes):
    names = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    weight = {k: [5, 2, 1][i % 3] for i, k in enumerate(names)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[k] for k in capped)
        total = sum(weight[k] for k in names if k not in capped)
        target = {k: 3 * sizes[k] if k in capped else rest * weight[k] / total for k in names}
        over = [k for k in names if k not in capped and target[k] > 3 * sizes[k] + 1e-9]
        if not over:
            return target
        capped |= set(over)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_mixing(request, table):
    docs = request.getfixturevalue(table)
    known, segments = mixing.mix_sources(docs, shards=5)
    got, drawn = mixing.taken(known, segments).toPandas(), segments.toPandas()
    assert sorted(got["size"]) == sorted(len(WORD.findall(r.text or "")) for r in docs.collect())
    got["source"] = got.source.astype(object).where(got.source.notna(), None)
    sizes = {None if pd.isna(k) else k: int(g["size"].sum()) for k, g in got.groupby("source", dropna=False)}
    target = water_fill(sizes)
    for k, g in got.groupby("source", dropna=False):
        k = None if pd.isna(k) else k
        assert (abs(g.target - target[k]) < 1e-6).all() and (g.source_size == sizes[k]).all()
        assert abs(g.taken.sum() - target[k]) <= 1 + sizes[k] / 1000
    assert (got.taken <= 3 * got["size"]).all()
    assert not drawn.duplicated(["row_key", "epoch", "start"]).any()
    by_shard = drawn.groupby("shard").length.sum()
    assert by_shard.max() - by_shard.min() <= 0.1 * by_shard.mean() + 10
    again = mixing.taken(*mixing.mix_sources(docs, shards=5)).toPandas()
    assert sorted(zip(again.id.fillna(-1), again.taken)) == sorted(zip(got.id.fillna(-1), got.taken))


def test_mixed_documents_hold_the_drawn_words(documents):
    words = lambda rows: sorted(w for r in rows for w in WORD.findall(r.text or ""))
    mix = mixing.mixed_documents(documents, shards=3)
    assert mix.columns == documents.columns
    have, source = mix.collect(), words(documents.collect())
    assert len(words(have)) == pytest.approx(len(source), rel=0.01) and set(words(have)) <= set(source)
    assert all(r.n_chars == len(r.text) for r in have)
    assert mixing.mixed_documents(documents.where("false")).count() == 0


def test_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 1025):
        assert sorted(mixing.permuted(np.arange(n), n, 7)) == list(range(n))


@pytest.mark.parametrize("table, window", [("odd", 64), ("odd", 4096), ("documents", 4096)])
def test_packing_round_trip(request, table, window):
    docs = request.getfixturevalue(table)
    got = packing.pack(docs, window=window).toPandas()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        ends = g.length.cumsum()
        assert (g.offset.to_numpy() == np.concatenate([[0], ends[:-1]])).all()
        assert ends.iloc[-1] == window or ends.iloc[-1] & (ends.iloc[-1] - 1) == 0 and ends.iloc[-1] < window
    plain = tokens.encoder(tokens.default_path()).tokenizer
    want = sorted((-1 if r.doc_id is None else r.doc_id, tuple(plain.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in docs.collect())
    have = [(g.doc_id.fillna(-1).iloc[0], tuple(np.concatenate([np.frombuffer(x, "<u4") for x in g.sort_values("start").ids]).tolist())) for _, g in got.groupby("row_key")]
    assert sorted(have) == want
    assert all(zlib.crc32(x) == c for x, c in zip(got.ids, got.ids_crc32))


@pytest.mark.parametrize("window,min_piece", [(1024, 1), (4096, 64), (256, 64)])
def test_windows_hold_the_target_shares(documents, window, min_piece):
    """Own tokens per window against the quantum: a queue's carried fraction, the
    lag behind the rounds and, where quanta are small, its own and others' turns."""
    got = packing.pack(documents, window=window, min_piece=min_piece).toPandas()
    share = got.groupby("source", dropna=False).length.sum() / got.length.sum()
    held = got[got.sequence_id < got.length.sum() // window].pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum").fillna(0)
    sources, small = len(share), (share * window < min_piece).any()
    for k in held.columns:
        off = abs(held[k].cumsum() - share[k] * window * (held.index.to_numpy() + 1))
        assert (off <= 2 * sources + (sources * min_piece if small else 0)).all()
    if not small:
        spread = sum(abs(held[k] / window - share[k]) for k in held.columns) / 2
        assert (spread <= 2 * sources / window).all()
    assert len(got) <= got.length.sum() / min_piece + got.length.sum() / window + 2 * got.row_key.nunique() + 16


def test_other_shares_last_until_a_queue_ends(spark):
    rows = [(k, "word " * 40, "ab"[k % 2] if k < 60 else "c") for k in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shares = spark.createDataFrame([("a", 0.75), ("b", 0.25), ("c", 0.0)], "source string, share double")
    got = packing.pack(docs, window=128, shares=shares, min_piece=16).toPandas()
    per = got.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum").fillna(0)
    assert (per.a[:10] == 96).all() and (per.b[:10] == 32).all() and not per.c[:18].any()  # c has no share: after a and b
    assert got[got.source == "a"].sequence_id.max() < got[got.source == "b"].sequence_id.max() <= got[got.source == "c"].sequence_id.min()
    assert got.length.sum() == 70 * 41


FRAGMENTS = ["It's", "don't ", "'tis", "a,b", "é!", "!é", "—.", "<|endoftext|>", "<|startoftext|>a", "́", "≠", "ABC", "İ", "12a", "", " ",
             " ", " ", "\n", "日本", "😀", "'RE", "Σ", "<|", "|>", "_a_", "\x00", "hello ", "t"]


def test_token_ids_equal_the_tokenizers():
    import pyarrow as pa
    from errata.llm import textops as T
    enc, rng = tokens.encoder(tokens.default_path()), random.Random(1)
    texts = [None, "", *("".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(1, 12))) for _ in range(4000))]
    for s in T.slices(pa.array(texts), 2000):
        ids, at = enc.encode(s)
        for i in range(s.rows):
            assert ids[at[i]:at[i + 1]].tolist() == enc.tokenizer.encode(texts[s.lo + i] or "", add_special_tokens=False).ids + [2]


def test_edits_recount_only_their_surroundings(spark):
    enc, rng = tokens.encoder(tokens.default_path()), random.Random(5)
    rows = [(0, None, None), (1, "", [(0, 5, "new")]), (2, "abc", None)]
    for i in range(3, 150):
        text = "".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 900)))
        rows.append((i, text, [(rng.randint(0, 900), rng.choice([None, rng.randint(0, 900)]), "".join(rng.choice(FRAGMENTS) for _ in range(4))) for _ in range(3)]))
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {recount.EDITS}")
    state = recount.count_trees(docs).join(docs.drop("text"), "doc_id")
    got = {r.doc_id: r for r in recount.recount(state).collect()}
    for i, text, edits in rows:
        text = text or ""
        assert got[i].n_before == len(enc.tokenizer.encode(text, add_special_tokens=False).ids)
        for a, b, new in edits or []:
            a = min(a, len(text))
            text = text[:a] + new + text[max(a, min(len(text), len(text) if b is None else b)):]
        assert got[i].n_after == len(enc.tokenizer.encode(text, add_special_tokens=False).ids) and got[i].n_chars_after == len(text)
    long = spark.createDataFrame([(1, "some words here, " * 20000, [(100, 110, "x")])], docs.schema)
    assert recount.recount(recount.count_trees(long).join(long.drop("text"), "doc_id")).first().n_encoded < 3000


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
    return d[-1]


def test_automaton_equals_edit_distance():
    words, rng = ["idiot", "scum", "worthless", "disgusting", "moron", "aaaaa"], random.Random(2)
    automaton = toxicity.LexiconAutomaton(words, ["lowe"])
    for _ in range(5000):
        w = list(rng.choice([*words, "lowei", "xyz"]))
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randint(0, len(w)), rng.choice("abcdeiost")) if rng.random() < 0.5 or not w else w.pop(rng.randrange(len(w)))
        w = "".join(w)
        fits = any(distance(w, t) <= toxicity.allowed_edits(t) for t in words)
        assert automaton.match(w) == (2 if w.startswith("lowe") else 1 if w in words else 3 if fits else 0), w


def test_quotation():
    m = toxicity.Matcher(["idiot"], [])
    direct, quoted = m.features("you idiot go away"), m.features('she said "you idiot" to him')
    assert direct[0] > 0 and direct[3] == 0 and quoted[0] == 0 and quoted[3] > 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert sum(r.predicted == r.toxic for r in got) >= 0.9 * len(got)
    odd = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity_scores(odd, labels.where("false")).collect())


def plain_paragraphs(t):
    n = len(t)
    size = sketches.PIECE if n <= sketches.LARGE else int(2 ** math.ceil(math.log2(n)) / sketches.PIECE)
    return set(re.findall((r"[^\n]{1,%d}[^ \t\n\x0b\f\r]*" if n <= sketches.LARGE else r"(?s).{1,%d}[^ \t\n\x0b\f\r]*") % size, t))


@pytest.mark.parametrize("table, bucket", [("odd", 2000), ("odd", 2), ("documents", 3)])
def test_fingerprints(request, monkeypatch, table, bucket):
    monkeypatch.setattr(sketches, "BUCKET_ROWS", bucket)
    docs = request.getfixturevalue(table)
    rows = sorted(((-(2 ** 63) if r.doc_id is None else r.doc_id), r.text or "") for r in docs.collect())
    want = []
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[:len(t) - q] + after[:q]
        alike = lambda a, b: 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))
        own = plain_paragraphs(t)
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(alike(own, plain_paragraphs(edited)), 9), round(alike(own, plain_paragraphs(after)), 9)))
    got = sketches.fingerprints(docs).collect()
    assert sorted(((-(2 ** 63) if r.doc_id is None else r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    prints = defaultdict(set)
    for r in got:
        prints[r.doc_id].add(r.fingerprint)
    assert table != "odd" or len(prints[1]) == 2  # the repeated rows share theirs


def test_fingerprints_of_long_texts_keep_their_likeness(spark):
    """One piece rule on both sides of 16384 and 32768 characters."""
    rng = random.Random(4)
    line = lambda: " ".join("w%d" % rng.randrange(10 ** 6) for _ in range(rng.randint(3, 30)))
    rows = []
    for n in (16500, 20000, 32800, 35662, 1_000_000):  # the short next text makes the edited one a quarter shorter
        text = ""
        while len(text) < n:
            text += line() + "\n"
        rows += [(len(rows), text[:n]), (len(rows) + 1, "short")]
    got = {r.doc_id: r for r in sketches.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[::2]:
        assert got[i].edited_recovered and got[i].next_recovered
        assert abs(got[i].near_edited - 2 * 0.75 / 1.75) < 0.03, len(text)


def test_empty_tables(spark, odd):
    none = odd.where("false")
    assert packing.pack(none).count() == sketches.fingerprints(none).count() == 0
    assert mixing.taken(*mixing.mix_sources(none)).count() == recount.count_trees(none).count() == 0


def test_near_copies_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g", 1, "x", 0, "r"), (2, "a b c d e f g", 2, "y", 0, "r"), (3, None, 3, "z", 0, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int, _row_key string, key int, row string")
    got = jaccard.drop_near_copies(docs)
    assert got.columns == docs.columns and sorted(r._row_key for r in got.collect()) in (["x", "z"], ["y", "z"])


@pytest.mark.parametrize("counts", [[10**10, 3 * 10**10, 0, 7], [5 * 10**11, 1, 10**12], [4 * 10**8, 7 * 10**8]])
def test_urns_of_any_size_are_split(counts):
    counts = np.array(counts, np.int64)
    total = int(counts.sum())
    for take in (0, 1, total // 2, total // 3, total - 1, total):
        left = mixing.draw_from_urn(np.random.default_rng(take % 97), counts, take)
        assert int(left.sum()) == take and (left >= 0).all() and (left <= counts).all()
        spread = np.sqrt(counts * (take / total) * (1 - take / total) + 1)
        assert (np.abs(left - counts * (take / total)) <= 7 * spread).all()


def test_large_urns_follow_the_law(monkeypatch):
    monkeypatch.setattr(mixing, "URN_LIMIT", 10)
    rng, counts = np.random.default_rng(1), np.array([6, 4, 10])
    draws = np.array([mixing.draw_from_urn(rng, counts, 7) for _ in range(20_000)])
    assert np.allclose(draws.mean(axis=0), 7 * counts / 20, atol=0.03)
    want = 7 * (counts / 20) * (1 - counts / 20) * 13 / 19  # of the hypergeometric law
    assert np.allclose(draws.var(axis=0), want, atol=0.04)
