"""Operators 11, 12 and 13 against plain re-computations."""

import bisect
import functools
import glob
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pytest

from errata.llm import alignment, repair, tokenfiles
from errata.llm import textops as T

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


ODD = [(1, "a b"), (1, "a b"), (None, "a b"), (2, None), (3, ""), (4, " "), (5, "  two  spaces \n x "), (6, "x▁y z"), (7, "<|endoftext|> <s> <0x41> </s>"),
       (8, "word " * 2000), (9, "tab\tx  y 　z \u0085q   w"), (10, "'s it's I'LL 12 34a é日本語 \U0001F600 \x00 ok"), (11, "trailing  "), (12, "y" * 9000)]


def odd(spark):
    rows = [(i, t, "q", 1, b"k") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, groups_sha256 string, copies int, key binary")


# ---------------------------------------------------------------- operator 11

def plain_alignment(rows):
    path_a, path_b = alignment.default_paths()
    both = alignment.Aligner(path_a, path_b)
    docs, counts = [], Counter()
    for i, t in rows:
        links, groups = [], []
        raw = (" " + (t or "")).encode()
        a = both.a.encode(raw.decode(), add_special_tokens=False).ids if t else []
        b = both.b.encode(t) if t else []
        if t and b"".join(both.bytes_a[x] for x in a) == raw == b"".join(both.bytes_b[x] for x in b):
            ends_a = list(itertools.accumulate(len(both.bytes_a[x]) for x in a))
            ends_b = list(itertools.accumulate(len(both.bytes_b[x]) for x in b))
            cuts = sorted(set(ends_a) & set(ends_b))
            parts = [defaultdict(list), defaultdict(list)]
            for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
                for x, e in zip(ids, ends):
                    parts[side][bisect.bisect_left(cuts, e)].append(str(x))
            groups = [",".join(parts[0][k]) + "|" + ",".join(parts[1][k]) for k in range(len(cuts))]
            starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
            j = 0
            for x, sa, ea in zip(a, starts_a, ends_a):
                while ends_b[j] <= sa:
                    j += 1
                k = j
                while k < len(b) and starts_b[k] < ea:
                    links.append((x, b[k]))
                    k += 1
        else:
            a = b = []
        counts.update(links)
        docs.append((i, len(a), len(b), groups, links))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted(((i, na, nb, len(g), len(ln), sum(counts[p] == top[p[1]] for p in ln), sum(counts[p] for p in ln),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, na, nb, g, ln in docs), key=str)


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT_PAIRS, 50, 0])
def test_alignment_equals_whole_texts(spark, documents, frequent):
    docs = documents.unionByName(odd(spark).select("doc_id", "text"))
    got = alignment.alignment_measures(docs, frequent_pairs=frequent).select(*COLS).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_alignment([tuple(r) for r in docs.collect()])


def test_alignment_odd_rows_and_names(spark):
    got = alignment.alignment_measures(odd(spark)).collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == plain_alignment(ODD)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].n_a == by_id[3].n_b == by_id[6].n_links == 0 and by_id[6].groups_sha256 == "" and by_id[None].copies == 3
    assert alignment.alignment_measures(odd(spark).where("false")).count() == 0


def test_chunks_equal_whole_texts():
    both = alignment.Aligner(*alignment.default_paths())
    assert both.cuts
    rnd = random.Random(5)
    alphabet = ["a", "the", "Zé", " ", "  ", "\n", "\t", " ", "　", " ", "'s", "'", ".", "12", "日本", "́", "\U0001F600", "ab1", "-", "\x7f", "\x1c", "\u0085", "<s>"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 30))) for _ in range(4000)]
    for lo in range(0, len(texts), 500):
        raws = [t.encode() for t in texts[lo:lo + 500]]
        measures, groups, keys, counts = both.texts(next(T.slices(pa.array(texts[lo:lo + 500]))))
        found = defaultdict(dict)
        for key, n in zip(keys.tolist(), counts.tolist()):
            found[key >> alignment.CODE_BITS][key & ((1 << alignment.CODE_BITS) - 1)] = n
        for i, raw in enumerate(raws):
            whole = both.align([b" " + raw])
            want = (*whole.counts[0, :3].tolist(), whole.groups[0], Counter(whole.links.tolist()))
            assert (*measures[i].tolist(), groups[i], found[i]) == want, raw


# ---------------------------------------------------------------- operator 12

def cheapest(codes):
    """(cost, letters) by plain recursion over all edits, two insertions in a row at most."""
    @functools.lru_cache(maxsize=None)
    def best(i, state, inserted):
        options = []
        if i == len(codes) and state in "^a":
            options.append((0, ""))
        if i < len(codes):
            c, s = best(i + 1, state, 0)
            options.append((c + 2, "D" + s))
            wanted = "a" if state == "u" else "u"
            if codes[i] != "-":
                own, more = codes[i].lower(), 5 if codes[i].isupper() else 0
                if own == wanted or (state == "^" and own == "s"):
                    c, s = best(i + 1, own, 0)
                    options.append((c + more, "K" + s))
                c, s = best(i + 1, wanted, 0)
                options.append((c + 1 + more, "R" + s))
        if inserted < 2:
            c, s = best(i, "a" if state == "u" else "u", inserted + 1)
            options.append((c + 5, "I" + s))
        return min(options, default=(1 << 40, ""))
    return best(0, "^", 0)


def test_auction_equals_plain_search():
    rnd = random.Random(3)
    for codes in ["".join(rnd.choice("uuuaaasxUASX-") for _ in range(rnd.randint(0, 45))) for _ in range(1500)]:
        assert repair.repair_path(codes) == cheapest(codes), codes
    for codes in map("".join, itertools.product("sua-xUA", repeat=4)):
        assert repair.repair_path(codes) == cheapest(codes), codes
    long = "".join(rnd.choice("uaUA") for _ in range(20000))
    cost, audit = repair.repair_path(long)
    assert len(audit) - audit.count("I") == 20000 and cost > 0


def plain_repair(rows):
    """Contract columns by conversation, row by row."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        shown = lambda x: " " if x is None else str(x)
        role, text = shown(role), shown(text)
        draw = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        groups[conv] += [(turn, role, text)] * (2 if draw == 3 else 1)
    out = []
    for conv, said in groups.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen, codes = Counter(), set(), ""
        for _, role, text in said:
            marks = WORD.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "-" if fault in ("blank", "duplicate") else c.upper() if fault == "truncated" else c
        turns = [t for t, _, _ in said if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        cost, audit = cheapest(codes)
        fixed, state, rest = [], "", iter(said)
        for letter in audit:
            wanted = "assistant" if state == "u" else "user"
            _, role, text = (None, wanted, "") if letter == "I" else next(rest)
            if letter != "D":
                role = wanted if letter in "IR" else role
                fixed.append(f"{role}:{text}")
                state = role[:1]
        assert re.fullmatch("(s?(ua)+)?", "".join(f[0] for f in fixed))
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return sorted(out, key=str)


def repaired(df):
    return sorted((tuple(r) for r in repair.repair_conversations(repair.damage(df)).collect()), key=str)


def test_repair_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert repaired(df) == plain_repair([tuple(r) for r in df.collect()])


def test_repair_odd_rows_and_long_conversations(spark, monkeypatch):
    rnd = random.Random(1)
    texts = ["Yes.", "No", "", None, " \t", "Why?", "é!", "a\nb. ", "Yes."]
    roles = ["user", "assistant", "system", None, "", "tool", "user", "assistant"]
    rows = [(rnd.choice([None, 1, 2, 3, 4, 5, 6]), rnd.choice([None, *range(-3, 60)]), rnd.choice(roles), rnd.choice(texts)) for _ in range(900)]
    rows += [(100 + i, 0, "user", "x.") for i in range(60)] + [(7, -(1 << 62), "user", "a."), (7, 5, "assistant", "b.")]
    df = spark.createDataFrame([(*r, "z", 9, 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, copies int, fault int")
    want = plain_repair(rows)
    assert repaired(df) == want
    assert any(r[7] == "" and r[8] == hashlib.sha256(b"").hexdigest() for r in want)
    assert repaired(df.where("false")) == []


def test_texts_beyond_the_held_bytes_are_streamed(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t} " + "x" * 400_000 + ".") for t in range(30)] + [(2, 0, "user", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert repaired(df) == plain_repair(rows)


# ---------------------------------------------------------------- operator 13

def plain_tokens(rows):
    from tokenizers import Tokenizer

    from errata.llm.tokens import default_path
    enc = Tokenizer.from_file(default_path())
    out, start = [], 0
    for i, t in rows:
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_every_document_in_order(spark, documents, tmp_path):
    path = str(tmp_path / "t")
    tokenfiles.write_tokens(documents.repartition(7), path, files=5)
    got = tokenfiles.token_digests(tokenfiles.read_tokens(spark, path)).drop("part").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == plain_tokens([tuple(r) for r in documents.orderBy("doc_id").collect()])
    files = sorted(glob.glob(f"{path}/tokens/*.orc"))
    assert len(files) == 5 and all(orc.ORCFile(f).nstripes >= 1 for f in files)


def index_bytes(spark, folder):
    jvm = spark._jvm
    sizes = []
    for f in glob.glob(f"{folder}/*.orc"):
        options = jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())
        stripes = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), options).getStripes()
        sizes += [stripes.get(k).getIndexLength() for k in range(stripes.size())]
    return sum(sizes)


def test_stripes_have_bloom_filters(spark, documents, tmp_path):
    path = str(tmp_path / "t")
    tokenfiles.write_tokens(documents, path, files=1)
    spark.read.orc(f"{path}/tokens").coalesce(1).write.orc(f"{path}/plain")
    assert index_bytes(spark, f"{path}/tokens") > index_bytes(spark, f"{path}/plain") > 0


def test_few_documents_are_found_by_pushed_filters(spark, documents, tmp_path):
    path = str(tmp_path / "t")
    tokenfiles.write_tokens(documents, path, files=3)
    found = tokenfiles.find_documents(spark, path, [3, 150, -1])
    assert "PushedFilters: [In(doc_id, [" in found._jdf.queryExecution().toString()
    assert sorted(r.doc_id for r in found.collect()) == [3, 150]


def test_files_of_odd_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    tokenfiles.write_tokens(odd(spark), path, files=4)
    got = tokenfiles.token_digests(tokenfiles.read_tokens(spark, path)).collect()
    ranked = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ranked] == [None, 1, 1, *range(2, 13)]
    assert [tuple(r)[:4] for r in ranked] == plain_tokens(sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)))
    empty = str(tmp_path / "e")
    tokenfiles.write_tokens(odd(spark).where("false"), empty)
    assert tokenfiles.read_tokens(spark, empty).count() == 0
