"""Prefix tries, fingerprints and alignments against plain Python."""

import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from check import connect, difference
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from wayside.llm import alignment, prefix_trie, winnow  # noqa: E402
from wayside.llm.catalogue import byte_model, op11, op12, op13, piece_model  # noqa: E402
from wayside.session import cut, join_counted, table  # noqa: E402

SF = "/root/testdata/sf0.001"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# --- prefix trie ----------------------------------------------------------------------------------


def rebuilt(rows):
    """rows (conv, turn, role, text) -> conversation: list of (role, text), each with the opening of another."""
    given = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            given[c].append(((turn is not None, turn or 0), role or "", text or ""))
    told = {c: [(role, text) for _, role, text in sorted(v)] for c, v in given.items()}
    out = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = told.get(c - c % 20, [])[:h] + own[h:]
    return out


def trie_nodes(told):
    members = defaultdict(list)
    for c, turns in told.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    n_words = {p: len(brute.words(p[-1][1])) if p else 0 for p in members}
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * n_words[p]
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else -1, len(cs), kids[p], leaves[p], saved[p],
                   brute.sha(",".join(str(c) for c in sorted(cs) if len(told[c]) == len(p)))) for p, cs in members.items())


def answer(nodes):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in NODE) for r in nodes.collect())


def conversations(seed, n):
    """Openings shared by many, one conversation copied often, short bases, missing bases, ties, nulls and repeated turns."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        if c % 20 == 0 and rng.random() < 0.3:
            continue  # a base that is not there
        if rng.random() < 0.3:
            turns = [("user", "hi  there"), ("assistant", "hello\tyou\n"), ("user", "same same")]
        else:
            turns = [(["user", "assistant", None, ""][rng.integers(4)], [None, "", "a", "a b", "c d e"][rng.integers(5)]) for _ in range(rng.integers(1, 7))]
        rows += [(c, None if t == 0 and c % 7 == 0 else t, *said) for t, said in enumerate(turns)]
    rows += [(n + 5, 1, "user", "twice")] * 3 + [(None, 0, "user", "nobody's")] * 2 + [(n + 6, t, "user", "long") for t in range(60)]
    rows += [(n + 7, t, "user", "long") for t in range(70)] + [(n + 8, 0, "user", "x" * 100_000)]
    return rows


@pytest.mark.parametrize("width", [prefix_trie.MOST_WIDTH, 16])
def test_trie_of_rebuilt_conversations(spark, tmp_path, monkeypatch, width):
    """A sketch of 16 cells, which proves next to nothing, gives the same nodes as one that proves every tail."""
    monkeypatch.setattr(prefix_trie, "LEAST_WIDTH", min(width, 1 << 13))
    monkeypatch.setattr(prefix_trie.trie, "__defaults__", (None, width))
    rows = conversations(4, 150)
    frame = spark.createDataFrame([(*r, 9, 9) for r in rows], "conv_id long, turn long, role string, text string, depth int, last int")
    frame.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    assert answer(op11(spark, str(tmp_path))) == trie_nodes(rebuilt(rows))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns = prefix_trie.digested(none)
    assert prefix_trie.trie(turns).count() == 0
    members = spark.createDataFrame([(3,), (12,)], "conv_id long")
    assert answer(prefix_trie.trie(turns, members)) == [(3, 0, -1, 2, 0, 1, 0, brute.sha("3,12"))]


def test_long_id_lists_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LISTED", 50)
    ends = spark.range(3000).select(F.expr("IF(id % 3 = 0, 'a', concat('n', id % 40))").alias("node"), (F.col("id") * 7).alias("conv_id"))
    want = defaultdict(list)
    for i in range(3000):
        want["a" if i % 3 == 0 else f"n{i % 40}"].append(str(i * 7))
    got = {r.node: r.ends_sha256 for r in prefix_trie.id_lists(ends.repartition(6)).collect()}
    assert got == {node: brute.sha(",".join(ids)) for node, ids in want.items()}


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-2**62, 2**62, (2, 4000))
    one, two = prefix_trie.Sketch(1 << 13), prefix_trie.Sketch(1 << 13)
    one.add(x[:2500], y[:2500])
    two.add(x[2000:], y[2000:])  # 500 of them again
    for piece, counts in two.pieces():
        one.merge(piece, counts)
    single = one.single(x, y)
    assert not single[2000:2500].any() and single[np.r_[:2000, 2500:4000]].mean() > 0.8
    assert one.single(*rng.integers(-2**62, 2**62, (2, 100))).sum() >= 0


def test_trie_equals_sql(spark):
    assert difference(spark, connect(SF), SF, entry.queries()["op11_prefix_trie"], entry.oracle_sql()["op11_prefix_trie"]) is None


def test_counted_join_splits_frequent_keys(spark):
    rows = spark.range(1000).select(F.expr("IF(id < 400, 0, id)").alias("k"), "id")
    counted = cut(rows.groupBy("k").agg(F.count("*").alias("n")))
    for held in (2, 10, 10_000):
        met = join_counted(rows, counted, "k", "n", held)
        assert met.count() == 1000 and met.where("k = 0 AND n = 400").count() == 400
    assert join_counted(rows.where("false"), cut(counted.where("false")), "k", "n").count() == 0


# --- fingerprints ---------------------------------------------------------------------------------


TEXTS = ["", None, "a", "short", "x" * 16, "exactly thirty-one letters here", "ab" * 400, "é𝄞ü " * 90, "line\none\r\n\ttwo " * 40, "\x00 nul " * 12,
         "The quick brown fox jumps over the lazy dog. " * 30, "same", "same", "word " * 9]


def edited(texts):
    out = []
    for t, n in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(t) // 2
        out.append(t[:len(t) - half] + n[:half])
    return out


def test_fingerprints_of_edited_texts(spark, tmp_path):
    """All columns of the query, with texts about as long as a run, a window and their multiples, and in one piece."""
    rng = np.random.default_rng(2)
    some = lambda n: " ".join(rng.choice(["to", "be", "or", "not", "日本", "x,y"], n))
    texts = TEXTS + [some(n) for n in (3, 4, 5, 10, 11, 12, 21, 22, 23, 400, 2600)] + ["q" * 3000, "字" * 300, " \t\n"]
    rows = [(100 - i if i else None, t, "e", "f") for i, t in enumerate(texts)] + [(100 - 8, "0 repeated id " * 20, "e", "f")]
    spark.createDataFrame(rows, "doc_id long, text string, marks string, fingerprint string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = op12(spark, str(tmp_path)).collect()
    tie = {t: h for t, h in spark.createDataFrame([(r[1] or "",) for r in rows], "t string").select("t", F.xxhash64("t")).collect()}
    inorder = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1] or ""]))
    whole = [r[1] or "" for r in inorder]
    how = winnow.Winnow()
    marks = lambda t: brute.winnowed(t, how.k, how.w, winnow.PRIME, winnow.BASE)
    spelled = lambda t: ",".join(f"{p}:{h:x}" for p, h in marks(t))
    want = [(r[0], len(t), brute.sha(e), spelled(t), spelled(e), brute.alike(marks(t), marks(e)), brute.alike(marks(t), marks(n)))
            for r, t, e, n in zip(inorder, whole, edited(whole), whole[1:] + whole[:1], strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    spark.createDataFrame(rows[:1], "doc_id long, text string, a string, b string").where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert op12(spark, str(tmp_path / "none")).count() == 0


def test_shared_passages_are_found_in_both_texts(spark):
    """The guarantee: a passage as long as a window leaves a common hash at corresponding places."""
    rng = np.random.default_rng(8)
    how = winnow.Winnow(4, 4)
    random_text = lambda n: "".join(f" {x}" for x in rng.integers(0, 500, n))
    rows, at = [], {}
    for i in range(60):
        passage, left, right = random_text(how.reach), random_text(rng.integers(0, 50)), random_text(rng.integers(0, 50))
        rows += [(2 * i, left + passage + random_text(9)), (2 * i + 1, right + passage + random_text(30))]
        at[i] = left.count(" "), right.count(" ")
    got = {r.doc_id: {tuple(m) for m in r.fingerprint} for r in winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), how=how).collect()}
    for i, (a, b) in at.items():
        assert {(p - a, h) for p, h in got[2 * i]} & {(p - b, h) for p, h in got[2 * i + 1]}
    with pytest.raises(ValueError):
        winnow.Winnow(12, 4)


def test_fingerprints_equal_sql(spark):
    assert difference(spark, connect(SF), SF, entry.queries()["op12_winnowing"], entry.oracle_sql()["op12_winnowing"]) is None


# --- alignment ------------------------------------------------------------------------------------


def aligned_by_hand(texts):
    """Whole texts through both libraries; groups by common ends; one tuple per text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(byte_model())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    letters = {c: bytes([i]) for i, c in enumerate(
        [chr(i) if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174 else "" for i in range(256)]) if c}
    missing = [i for i in range(256) if not (33 <= i <= 126 or 161 <= i <= 172 or i >= 174)]
    letters |= {chr(256 + k): bytes([i]) for k, i in enumerate(missing)}
    found = []
    for text in texts:
        none = (0, 0, [])
        if not text:
            found.append(none)
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        pa = [b"".join(letters[c] for c in a.id_to_token(i)) for i in ia]
        pb = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ib)]
        if b"".join(pa) != (" " + text).encode() or b"".join(pb) != (" " + text).encode():
            found.append(none)
            continue
        ends_a, ends_b = list(np.cumsum([len(p) for p in pa])), list(np.cumsum([len(p) for p in pb]))
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            ga = [x for x, e in zip(ia[i:], ends_a[i:], strict=True) if e <= end]
            gb = [x for x, e in zip(ib[j:], ends_b[j:], strict=True) if e <= end]
            groups.append((ga, gb))
            i, j = i + len(ga), j + len(gb)
        found.append((len(ia), len(ib), groups))
    held = Counter(p for _, _, groups in found for p in {(x, y) for ga, gb in groups for x in ga for y in gb})
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for na, nb, groups in found:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        spelled = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((na, nb, len(groups), len(links), sum(held[x, y] == most[x] for x, y in links), sum(held[p] for p in links),
                    brute.sha(spelled) if groups else ""))
    return out


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b\n  c\t d", "it's we'll I'd", "1234567 89", "▁", "a▁b", "x ▁ y", "é ü 𝄞 日本語 テスト",
       "<|endoftext|> </s> <s> <unk> <0x0A>", "\x00\x01 \x7f", "a b 　c", "  x\u0085y", "é ﬁ ①", "👩‍👩‍👧 ok", "!!!??? ... ---", "a" * 3000,
       "  lead", "trail  ", "tab\t\tx", "\x1c y \x1f z", "www.example.com/a?b=c&d=e", "\r\n\r\n", "word " * 400, "repeat", "repeat", "﻿bom", "a​b ᠎ c"]


def test_alignment_by_hand(spark, tmp_path):
    rng = np.random.default_rng(6)
    letters = [" ", " ", " ", "a", "b", "é", "\n", "\t", "1", "9", ".", "'s", "the", "日", " ", "▁", "<", "\x1d", "Z", "👍"]
    texts = ODD + ["".join(rng.choice(letters[:15] if i % 3 else letters, rng.integers(1, 60))) for i in range(400)]
    texts += [r.text for r in table(spark, SF, "documents").orderBy("doc_id").limit(60).collect()]
    frame = spark.createDataFrame([(i, t, 5, "n") for i, t in enumerate(texts)], "doc_id long, text string, n long, pairs string")
    frame.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r[0]: tuple(r[1:]) for r in op13(spark, str(tmp_path)).collect()}
    want = aligned_by_hand(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (texts[i], got[i], w)


def test_alignment_with_few_frequent_pairs(spark):
    """Whatever share of the pairs is broadcast, the sums are the same; nameless and repeated rows are documents each."""
    docs = spark.createDataFrame([(i % 7 or None, f"a word {i % 5} and more") for i in range(40)], "doc_id long, text string").repartition(3)
    found = [sorted(map(str, alignment.with_counts(alignment.align(docs, byte_model(), piece_model()), held).collect())) for held in (1, 8, 10**6)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 40
    assert alignment.with_counts(alignment.align(docs.where("false"), byte_model(), piece_model())).count() == 0
