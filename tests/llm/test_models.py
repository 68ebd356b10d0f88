"""Classifiers: held-out accuracy, what they may see, and edge rows."""

import bisect
import decimal
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, quality, queries, toxicity
from tessera.llm import words as W

LARGER = "/root/testdata/sf0.1"


def judged(spark, query, label):
    out = query(spark, LARGER)
    return out.join(spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", label), "doc_id").toPandas()


def area(score, label):
    rank = score.rank()
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_quality_on_held_out(spark):
    p = judged(spark, queries.op1_quality_classifier, "quality")
    held = p[p.held_out]
    assert area(held.score, held.quality) > 0.98 and (held.predicted == held.quality).mean() > 0.97
    assert p.score.between(0, 1).all() and (p.predicted == (p.score >= 0.3)).all()


def test_toxicity_on_held_out(spark):
    p = judged(spark, queries.op10_toxicity, "toxic")
    held = p[p.held_out]
    assert held[held.toxic == 0].predicted.mean() < 0.01 and held[held.toxic == 1].predicted.mean() > 0.7
    assert (p.predicted == (p.score >= 0.7)).all()


def test_language_on_held_out(spark):
    p = queries.op8_language_id(spark, LARGER).join(spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = p[p.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and p.score.between(0, 1).all()


@pytest.mark.parametrize("op", [quality.quality, toxicity.toxicity])
def test_classifiers_take_edge_rows(spark, edge, op):
    labels = spark.createDataFrame([(i, i % 2, int(i == 13)) for i in range(1, 17)] + [(None, 1, 1), (3, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    rows = op(edge, labels, held_out=-1).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len(op(edge, labels.limit(0)).collect()) == len(rows) and op(edge.limit(0), labels).count() == 0


def test_toxicity_locates_the_sentence(spark):
    clean = [f"a quiet sentence number {i} here." for i in range(400)]
    docs = [(i, f"{clean[i]} {'You utter blockhead ' + str(i) + '.' if i % 4 == 0 else clean[-i]} {clean[i // 2]}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    out = toxicity.toxicity(df, labels, held_out=-1)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert all(rows[i]["predicted"] == int(i % 4 == 0) for i in rows)
    found = rows[8]["offending"]
    assert [x["sentence"] for x in found] == [1] and found[0]["text"].startswith("You utter blockhead")
    assert {r["doc_id"] for r in toxicity.keep_clean(df, labels, held_out=-1).collect()} == {i for i in rows if i % 4}


def test_noisy_or_puts_the_weight_on_what_explains_a_label():
    import pandas as pd

    pack = lambda x: np.array(x, np.int32).tobytes()
    bags = pd.DataFrame([(1, 3, pack([0, 1]), pack([0, 1])), (0, 3, pack([2]), pack([1])), (1, 2, pack([1]), pack([0])), (0, 2, pack([0]), pack([1]))] * 10, columns=["label", "n", "sentence", "feature"])
    w, bias = toxicity.noisy_or(toxicity.Bags.of(bags), np.zeros(2))
    assert w[0] > 3 > w[1] and bias < -2


def test_language_backs_off(spark):
    docs = spark.createDataFrame([(i, "the river runs northward slowly", "en") for i in range(8)] + [(i, "der fluss fließt langsam nordwärts", "de") for i in range(10, 18)], "doc_id long, text string, lang string")
    model = langid.fit(docs.select("text", "lang"))
    new = spark.createDataFrame([(1, "rivers slow"), (2, "flüsse nordwärts"), (3, "123 !!"), (4, None), (5, ""), (6, "日本")], "doc_id long, text string")
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(new, model).collect()}
    assert rows[1][0] == "en" and rows[2][0] == "de" and rows[3] == rows[4] == rows[5] == ("und", 0.0) and rows[6][0] in ("de", "en")
    assert {r["lang_pred"] for r in langid.predict(new, None).collect()} == {"und"}


def test_language_of_few_documents_is_learned(spark):
    """Words and n-grams of a small language count, whatever larger ones bring along."""
    import itertools

    many = ["".join(x) for x in itertools.product("bcdfghklmnprstvz", "aeiou", "bcdfghklmnprstvz", "aeiou", "bcdfghklmnprstvz")]
    docs = [(i, " ".join(many[i::25]) + " " + " ".join(many[i::25]), "en") for i in range(25)] * 3 + [(100 + i, "жуков щёлк", "ru") for i in range(2)]
    assert len(many) > 40_000 and all(len(set(many[i::25])) > 1000 for i in range(25))
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string").select("text", "lang"))
    new = spark.createDataFrame([(1, "жуков щёлк"), (2, "жуковый"), (3, "щ щ щ щ щ"), (4, " ".join(many[:20]))], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(new, model).collect()} == {1: "ru", 2: "ru", 3: "ru", 4: "en"}


def test_what_is_broadcast_changes_no_language(spark, documents, monkeypatch):
    scores = lambda: {r["doc_id"]: (r["lang_pred"], round(r["score"], 5)) for r in langid.identify(documents).collect()}
    want = scores()
    monkeypatch.setattr(langid, "HOT_WORDS", 50)
    monkeypatch.setattr(langid, "HOT_GRAMS", 20)
    assert scores() == want


def test_language_takes_edge_rows(edge):
    rows = langid.identify(edge).collect()
    assert len(rows) == edge.count() and all(r["lang_pred"] in ("en", "und") for r in rows)
    assert langid.identify(edge.limit(0)).count() == 0


def test_boosting_finds_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.boost(x, y)
    assert set(model.pairs[0]) == {0, 1} and ((model.score(x) > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize(("op", "label", "parts", "rest"), [(toxicity.toxicity, "toxic", 3, 1), (quality.quality, "quality", 5, 0)])
def test_held_out_rows_teach_nothing(spark, documents, sf_dir, op, label, parts, rest):
    """Other labels in the held-out part leave every score as it was."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = F.when(queries.held_out(parts, rest), 1 - F.col(label)).otherwise(F.col(label)).alias(label)
    scores = lambda table: {r["doc_id"]: round(r["score"], 9) for r in op(documents, table).collect()}
    assert scores(labels) == scores(labels.select("doc_id", turned))


def test_held_out_languages_teach_nothing(documents):
    turned = documents.withColumn("lang", F.when(queries.held_out(4, 2), F.lit("xx")).otherwise(F.col("lang"))).withColumn("text", F.col("text"))
    scores = lambda docs: {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in langid.identify(docs).collect()}
    assert scores(documents) == scores(turned)


ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " \n", "Idiot!", "you are an idiot. fine day.\nSecond line? yes", "é" * 30 + " " + "x" * 600 + ". tail", "word " * 3000, "a|b|c 1,2;3 #tag", "日本語 тест. ok"]


def plain_mix(h):
    m = (1 << 64) - 1
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m
    h = (h ^ h >> 27) * 0x94D049BB133111EB & m
    return h ^ h >> 31


def plain_value(word, base):
    if len(word) <= 7:
        return int.from_bytes(word, "little") + (len(word) << 56)
    value = 0
    for at in range(0, len(word), 7):
        value = (value * base + int.from_bytes(word[at : at + 7], "little")) % W.PRIME
    return (value * base + len(word)) % W.PRIME


def test_toxicity_scores_are_the_plain_ones(spark, documents, sf_dir):
    """Noisy-or by hand over the sentences of each text."""
    model = toxicity.fit(documents.selectExpr("doc_id as id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), grid=[(True, 6.0, 400.0)])
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    texts = [*ODD, *(r["text"] for r in documents.select("text").limit(100).collect())]
    assert len(weights) > 3
    for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), model).collect():
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["id"]] or "")):
            words = [x.encode() for x in ITEM.findall(sentence)]
            if words:
                found = {plain_mix(plain_value(x, W.FIXED.word[0])) for x in words}
                found |= {plain_mix(int.from_bytes(x[:n], "little") | ((n << 3) + 7) << 56) for x in words for n in (4, 5)}
                z = model.bias + sum(weights.get(f, 0.0) for f in found)
                clean *= 1 - 1 / (1 + math.exp(-z))
        assert r["score"] == pytest.approx(1 - clean, abs=1e-9)


def test_toxicity_settings_come_from_the_teachable_rows(spark, documents, sf_dir):
    """A setting that cannot explain the labels does not win, whichever comes first; training rows are bounded by bytes too."""
    docs = spark.createDataFrame([(i, f"a quiet sentence number {i} here. {'You blockhead.' if i % 4 == 0 else 'Well then.'}") for i in range(400)], "id long, text string")
    own = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    useless, useful = (True, 1e9, 400.0), (True, 6.0, 400.0)
    assert [toxicity.fit(docs, own, grid=g).setting for g in ([useless, useful], [useful, useless])] == [useful, useful]
    ids, labels = documents.selectExpr("doc_id as id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = toxicity.training_rows(ids, labels, "toxic", 3, 1, 100, toxicity.Scratch(spark, "test"), max_bytes=20_000)
    assert 0 < rows.agg(F.sum(F.octet_length("text"))).first()[0] <= 20_000 and rows.filter("crc32(cast(cast(id as string) as binary)) % 3 = 1").isEmpty()


def test_quality_scores_are_the_plain_ones(spark, documents, sf_dir):
    """The features of each text by plain counting, and the sum of one table entry for each feature and pair."""
    texts = [*ODD, *(r["text"] for r in documents.select("text").limit(60).collect())]
    got = quality.features(*W.buffers(pa.array(texts, pa.string())))
    classes = [r"[A-Z]", r"[a-z]", r"[0-9]", r"[ \t\r\x0b\x0c]", r"\n", None, r"[.!?]", r"[,;:]", r"['\"()\[\]-]", r"[#$%&*@^~_=+<>{}\\/]", r"[|]"]
    for text, row in zip(texts, got):
        raw = (text or "").encode()
        words = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        if not words:
            assert not row.any()
            continue
        size, n = [len(x) for x in words], len(words)
        share = [raw.count(b) / len(raw) for b in set(raw)]
        triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
        mean = sum(size) / n
        want = [math.log1p(len(raw)), math.log1p(n), mean, math.sqrt(sum((x - mean) ** 2 for x in size) / n)]
        want += [(len(re.findall(c, text)) if c else sum(b > 127 for b in raw)) / len(raw) for c in classes]
        want += [-sum(x * math.log2(x) for x in share), len(set(words)) / n, max(map(words.count, set(words))) / n if n < 4000 else row[17], sum(a == b for a, b in zip(words, words[1:])) / (n - 1) if n > 1 else 0]
        want += [len(set(triples)) / len(triples) if triples else 1.0, math.log1p(n / (raw.count(b"\n") + 1)), sum(x > 15 for x in size) / n]
        assert row == pytest.approx(want, abs=1e-9)
    rng = np.random.default_rng(5)
    x = rng.random((2000, 4))
    model = quality.boost(x, ((x[:, 0] > 0.4) & (x[:, 1] + x[:, 2] > 0.9)).astype(float))
    for row, score in zip(x[:200], model.score(x[:200])):
        z = model.intercept + sum(table[bisect.bisect_right(edges.tolist(), v)] for edges, table, v in zip(model.edges, model.tables, row))
        for (i, j), table in zip(model.pairs, model.pair_tables):
            z += table[bisect.bisect_right(model.coarse[i].tolist(), row[i]), bisect.bisect_right(model.coarse[j].tolist(), row[j])]
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_language_scores_are_the_plain_ones(spark, documents):
    """Words one by one, unknown ones by their longest known n-grams."""
    some = documents.filter("doc_id % 3 > 0")
    model = langid.fit(some.select("text", "lang"))
    values = [f"v{i}" for i in range(len(model.langs))]
    words, grams = ({r[0]: [r[v] for v in values] for r in t.rows.collect()} for t in (model.words, model.grams))
    texts = [*ODD, "zzyzx qwv", *(r["text"] for r in documents.filter("doc_id % 3 = 0").select("text").limit(40).collect())]
    unknown = 0
    for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect():
        text = texts[r["doc_id"]]
        if not re.search(r"[^\W\d_]", text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = [0] * len(values)
        for word in langid.words_of(text):
            row = words.get(word.decode())
            if row is None:
                unknown += 1
                for size in range(5, 0, -1):
                    own = [grams[g] for g in langid.grams_of(word.decode(), size) if g in grams]
                    if own:
                        row = [int(decimal.Decimal(sum(x) / len(own)).quantize(decimal.Decimal(1), decimal.ROUND_HALF_UP)) for x in zip(*own)]
                        break
            total = [a + b for a, b in zip(total, row or [0] * len(values))]
        z = [t / langid.UNIT + float(p) for t, p in zip(total, model.prior)]
        assert r["lang_pred"] == model.langs[z.index(max(z))] and r["score"] == pytest.approx(1 / sum(math.exp(x - max(z)) for x in z), abs=1e-9)
    assert unknown > 3


def test_equal_languages_the_first_by_name(spark):
    docs = spark.createDataFrame([(1, "same words here", "nl"), (2, "same words here", "de"), (3, "same words here", "sv")], "doc_id long, text string, lang string")
    model = langid.fit(docs.select("text", "lang"))
    assert {r["lang_pred"] for r in langid.predict(docs.select("doc_id", "text"), model).collect()} == {"de"}
