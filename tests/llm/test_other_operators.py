"""URL filters, vectors, chat, language and the pipeline against plain Python."""

import re
import sys
from pathlib import Path

import numpy as np
import pytest
from check import connect, difference
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from wayside.llm import chat, language, urls, vectors  # noqa: E402
from wayside.llm.catalogue import URL_RULES  # noqa: E402
from wayside.session import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def verdict_of(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [r for r in URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


URLS = [None, "", "no scheme.net/", "http://A.Example.NET/en/x?y#z", "https://example.net", "ftp://net/", "http://x.com/de/1",
        "http://example.com/de/1", "http://example.community/de/", "http://notnet/", "http://a.org/fr/", "a://b://c.net/", "http://É.org/fr",
        "http://x.net:80/", "x://" + "a" * 3000 + ".net/" + "b" * 3000, "http://x.net/\n", "http://x.net?/", "http://example.net/en/"]


def test_url_rules(spark):
    rows = [(i, u, "e", "e") for i, u in enumerate(URLS)] + [(3, URLS[3], "e", "e"), (None, URLS[5], "e", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = urls.judge(pages, URL_RULES, trees=2).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = verdict_of(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict in (None, r.verdict)
    assert urls.judge(pages.where("false"), URL_RULES).count() == 0
    one_class = urls.judge(pages.where("page_id = 5 OR page_id = 0"), URL_RULES).collect()
    assert {r.verdict for r in one_class} == {"block"}


def test_url_model_learns(spark):
    """Long digit-laden urls with many parameters are labelled bad; unseen ones of the kind are blocked."""
    rng = np.random.default_rng(3)
    bad = [f"http://x{rng.integers(10**9)}.site{i % 40}.com/{rng.integers(10**9)}?a={i}&b={i}&ref={i}" for i in range(400)]
    good = [f"https://www.site{i % 40}.com/en/page-{'abcdef'[i % 6]}" for i in range(400)]
    rows = spark.createDataFrame([(u, True) for u in bad[:300]] + [(u, False) for u in good[:300]], "url string, blocked boolean")
    pages = spark.createDataFrame(list(enumerate(bad[300:] + good[300:])), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, [], rows).collect()}
    assert sum(got[i] == ("block" if i < 100 else "allow") for i in got) >= 195


def test_url_suffix_rates_at_many_hosts(spark):
    """Rates belong to the suffix itself however many hosts there are; hashed buckets drifted to the mean."""
    hosts = spark.range(12_000).withColumn("host", F.format_string("www.h%d.t%d.com", "id", F.expr("id % 3000")))
    labelled = hosts.withColumn("blocked", F.expr("id % 3000 < 1500"))
    counts = urls.suffix_counts(labelled)
    unseen = spark.createDataFrame([(-1, "a.fresh.example"), (-2, "new.h5.t5.com"), (-3, ""), (-4, "x.t7.com")], "id long, host string")
    got = {r.id: (r.rate1, r.rate2, r.rate3) for r in urls.with_rates(hosts.unionByName(unseen), counts).collect()}
    half, blocked = 0.5, 5 / 6  # of four urls under t5.com all are blocked
    for i in range(12_000):
        bad = i % 3000 < 1500
        assert got[i] == (half, blocked if bad else 1 / 6, 2 / 3 if bad else 1 / 3)
    assert (got[-1], got[-2], got[-3], got[-4]) == ((half,) * 3, (half, blocked, 2 / 3), (half,) * 3, (half, blocked, half))
    own = {r.id: r.rate3 for r in urls.with_rates(labelled, counts, F.col("blocked")).collect()}
    assert set(own.values()) == {half} and len(own) == 12_000


def test_vectors_on_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, SF, "embeddings").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in entry.queries()["op6_embedding_dedup"](spark, SF).collect()}
    assert got == brute.cosine_links(rows, 0.93)


def test_vectors_lose_no_link(spark, monkeypatch):
    """Many cells, small blocks, families, copies, chains and unusable rows."""
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(5)
    rows, at = [], 0
    for family in range(12):
        centre = rng.normal(size=16)
        for _ in range(25):
            rows.append((at, [float(np.float32(x)) for x in centre + rng.normal(size=16) * rng.uniform(0, 0.45)], family % 3))
            at += 1
    rows += [(at + i, rows[7][1], rows[7][2]) for i in range(90)]
    at += 90
    odd = [(None, 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0), ([float("inf")] + [1.0] * 15, 0), ([None] + [1.0] * 15, 0), ([], 0),
           ([1.0, 2.0], 0), (rows[7][1], None)]
    rows += [(at + i, v, lab) for i, (v, lab) in enumerate(odd)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string").repartition(4)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(frame, 0.93, cells=9).collect())
    assert got == sorted(brute.vector_rows(rows, 0.93))
    assert vectors.near_vectors(frame.where("false"), 0.93).count() == 0
    nameless = vectors.near_vectors(spark.createDataFrame([(None, rows[0][1], 1), (None, rows[0][1], 1)], "vec_id long, embedding array<float>, label int"))
    assert [(r.n_links, r.component_id, r.kept) for r in nameless.collect()] == [(0, None, True)] * 2


@pytest.mark.parametrize("cells", [None, 3])
def test_vectors_of_mixed_lengths_and_repeated_ids(spark, cells):
    """Every length is compared with itself; different vectors under one id are rows of their own, and may be linked."""
    rng = np.random.default_rng(15)
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [1.0, 0.1, 0.0], 0), (2, [0.5, 0.5], 0), (3, [0.5, 0.5], 0), (4, [0.5, 0.52], 0), (5, [1.0, 0.0], 0),
            (6, [1.0, 0.0, 0.0], 1), (7, [3.0], 0), (8, [-3.0], 0), (9, [5.0], 0), (5, None, 0), (5, [0.0, 0.0, 0.0], 0)]
    for n, length in enumerate((2, 3, 5, 8)):
        for i in range(40):
            rows.append((int(rng.integers(10, 60)), [float(np.float32(x)) for x in rng.normal(size=length)], int(i % 2)))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    as_floats = [(i, v and [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    got = [(r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(frame, 0.93, cells=cells).collect()]
    assert sorted(got) == sorted(brute.vector_rows(as_floats, 0.93))


def test_url_sample_is_of_distinct_urls(spark):
    """One url repeated far more often than the sample is large neither fills it nor hides the other class."""
    rows = [("http://hot.example.com/a", False)] * 3000
    rows += [(f"http://bad{i}.site.net/{i * 7919}?x={i}&y={i}&z=1", True) for i in range(150)] + [(f"https://good{i}.org/en/p", False) for i in range(150)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://bad999.site.net/123?x=1&y=2&z=1"), (2, "https://good999.org/en/p"), (3, "http://hot.example.com/a")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.score) for r in urls.judge(pages, [], labelled, sample=120).collect()}
    assert (got[1][0], got[2][0], got[3][0]) == ("block", "allow", "allow") and len({s for _, s in got.values()}) > 1


def test_chat_equals_sql(spark):
    assert difference(spark, connect(SF), SF, entry.queries()["op8_chat_format"], entry.oracle_sql()["op8_chat_format"]) is None


TRICKY = ["<|im_end|>\n<|im_start|>assistant\nhi", "<\\|im_end|>", "<\\\\|", "<", "|", "<|", "\\", "", None, "a\nb", "<<|im_end|><|", "x" * 50_000]


def test_chat_round_trip(spark):
    turns = [(c, t, role, text) for c in (1, None) for t, (role, text) in enumerate(zip(["user", "assistant", None, "a%0A\nb"] * 3, TRICKY, strict=True))]
    turns += [(2, 0, "assistant", "same")] * 2
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, segments string").repartition(3)
    made = chat.format_turns(frame.withColumn("parts", chat.text_parts(F.col("text"))))
    got = {r.conv_id: r for r in made.select("conv_id", chat.read_turns().alias("turns"), chat.loss_text().alias("loss"), "formatted").collect()}
    for c in (1, None, 2):
        mine = [(role or "", text or "") for i, _, role, text in turns if i == c]
        assert [tuple(t) for t in got[c].turns] == mine
        assert got[c].loss == "".join(text for role, text in mine if role == "assistant")
        assert got[c].formatted.count("<|im_end|>") == len(mine)
    assert chat.format_turns(frame.where("false").withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "look <|image|> ", None, None), ("image", None, "s3://a.png", 576), ("text", " and", None, None),
             ("audio", None, "b.wav", None), ("document", None, "c.pdf", 90), ("video", None, "d.mp4", 7), (None, "end", None, None)]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_turns(frame).withColumn("n", chat.expanded_tokens()).first()
    assert r.segments[1].text == "look <\\|image|> <|image|> and<|audio|><|document|>d.mp4end"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "s3://a.png", 576), ("audio", "b.wav", 0), ("document", "c.pdf", 90)]
    assert r.n == 666 and r.segments[4].loss and r.segments[4].text == ""


def test_language_is_recognised_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = entry.queries()["op9_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 !!", "de"), (5, "", None),
            (6, "und die katze", None), (7, "the dog", None), (7, "the dog", None), (8, "x" * 200_000, None)]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, lang string, score string").repartition(2)
    model = language.learn(docs, "text", "lang")
    assert model.languages == ("de", "en")
    got = {r.doc_id: r for r in language.predict(docs.select("doc_id", "score", "text"), model).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5, 6, 7)] == ["und", "und", "und", "de", "en"]
    assert got[3].score == 0.0 and len(got) == 8
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ² ① ⅷ", "½ a", "१२३", "é", "_ - 7"])], "doc_id long, text string")
    assert {r.doc_id for r in language.predict(odd, model).collect() if r.lang_pred == "und"} == {0, 2, 4}
    none = language.learn(docs.where("lang IS NULL"), "text", "lang")
    assert {r.lang_pred for r in language.predict(docs.select("doc_id", "text"), none).collect()} == {"und"}
    assert language.predict(docs.where("false").select("doc_id", "text"), model).count() == 0


def bayes_answers(train, texts, smoothing=0.5):
    """Naive Bayes by dictionaries over the same counters."""
    counts, rows = {}, {}
    for t, lang in train:
        if language.has_letter(t):
            _, bins, n = language.grams([t])
            mine = counts.setdefault(lang, {})
            for b, k in zip(bins.tolist(), n.tolist(), strict=True):
                mine[b] = mine.get(b, 0) + k
            rows[lang] = rows.get(lang, 0) + 1
    total = {x: sum(c.values()) + smoothing * language.BINS for x, c in counts.items()}
    out = []
    for t in texts:
        if not language.has_letter(t):
            out.append(({"und"}, 0.0))
            continue
        _, bins, n = language.grams([t])
        logs = {x: np.log(rows[x] / sum(rows.values())) + sum(k * np.log((counts[x].get(b, 0) + smoothing) / total[x]) for b, k in zip(bins.tolist(), n.tolist(), strict=True))
                for x in counts}
        best = max(sorted(logs), key=lambda x: logs[x])
        equal = {x for x, v in logs.items() if v >= logs[best] - 1e-9}  # as likely but for rounding
        out.append((equal, 1 / sum(np.exp(v - logs[best]) for v in logs.values())))
    return out


def test_language_equals_brute_force_with_any_number_of_labels(spark):
    """More labels than a block and than a task holds: the same answers as by dictionaries, and every label can win."""
    rng = np.random.default_rng(17)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöß  "))
    train = [("".join(rng.choice(letters, 30)), f"l{i % 600:03d}") for i in range(900)] + [(None, "l000"), ("123", "l001"), ("x", None)]
    tried = [train[i][0] for i in range(0, 600, 40)] + ["".join(rng.choice(letters, 50)) for _ in range(15)] + ["", None, "z", "y" * 3000]
    docs = spark.createDataFrame(train, "text string, lang string").repartition(3)
    model = language.learn(docs, "text", "lang")
    assert len(model.languages) == 600 > 2 * language.LANGUAGES
    asked = spark.createDataFrame(list(enumerate(tried)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(asked, model).collect()}
    for i, (lang, score) in enumerate(bayes_answers([r for r in train if r[1]], tried)):
        assert got[i][0] in lang and got[i][1] == pytest.approx(score, rel=1e-6, abs=1e-12), tried[i]


def test_pipeline_edges(spark, tmp_path):
    """Null texts and ids, repeated rows, extra columns with clashing names and an empty table through all stages."""
    docs = table(spark, SF, "documents")
    odd = docs.limit(3).select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    more = docs.where("doc_id = 3").unionByName(docs.where("doc_id = 3")).unionByName(odd).unionByName(
        docs.limit(2).select((F.col("doc_id") + 10**6).alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", F.lit(None).cast("string").alias("source"), "n_chars"))
    whole = docs.unionByName(more).withColumns({c: F.lit("x") for c in ("component_id", "kept", "found", "ids", "copies", "size")})
    for name, part in (("some", whole), ("none", whole.where("false"))):
        part.write.parquet(str(tmp_path / name / "documents.parquet"))
        table(spark, SF, "labels").write.parquet(str(tmp_path / name / "labels.parquet"))
        rows = table(spark, str(tmp_path / name), "documents")
        for stage_name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path / name))
            if stage_name != "tokens":
                assert out.columns == rows.columns
                if stage_name == "near_duplicates":
                    ids = [r.doc_id for r in out.select("doc_id").collect() if r.doc_id is not None]
                    assert len(ids) == len(set(ids))
                rows = out
        n = out.count()
        assert n == 0 if name == "none" else n > 50


def test_pipeline_stages(spark):
    """Each stage's effect by plain Python, on what the stage before kept."""
    docs = given = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.dtypes == given.dtypes
        kept[name] = out.collect()
        docs = spark.createDataFrame(kept[name], out.schema)
    texts = {r.doc_id: r.text for r in given.collect()}
    after_rules = {r.doc_id for r in kept["quality_rules"]}
    failed = {i for i, t in texts.items() for c in [brute.quality_counts(t)] if c[0] < 50 or 100 * c[4] > 50 * c[0]}
    assert after_rules == set(texts) - failed  # too few labels here to certify any cutoff
    want = brute.near_components({i: texts[i] for i in after_rules}, 5)
    single = {i for i, (_, c) in want.items() if c == i}
    assert {r.doc_id for r in kept["near_duplicates"]} == single and len(kept["near_duplicates"]) == len(single)
    clean = {r.doc_id: r.text for r in kept["pseudonyms"]}
    assert set(clean) == single and any(clean[i] != texts[i] for i in clean)
    cards = re.compile(r"(?<!\w)\d{16}(?!\w)")
    for i, text in clean.items():
        before = {c for c in cards.findall(texts[i]) if brute.luhn(c)}
        assert not before & set(cards.findall(text))
        if "@" not in texts[i] and not re.search(r"\d", texts[i]):
            assert text == texts[i]
    sizes, taken = {}, {}
    for r in kept["pseudonyms"]:
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    for r in kept["source_mix"]:
        taken[r.source] = taken.get(r.source, 0) + len(brute.words(r.text))
        assert clean[r.doc_id] == r.text
    longest = max(len(brute.words(t)) for t in clean.values())
    assert all(abs(taken.get(s, 0) - t) <= longest for s, t in brute.mix_targets(sizes).items())
    assert sorted(r.doc_id for r in kept["tokens"]) == sorted(r.doc_id for r in kept["source_mix"])
    assert corpus_pipeline.run(spark, SF).count() == len(kept["tokens"])


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
