"""The pipeline against a plain version of its stages, on the smallest tables."""

import duckdb
import numpy as np

import corpus_pipeline
from tallyspark.llm import bpe, langid, quality, secret_scan
from tests.llm.test_table_operators import plain_base, plain_components


def plain_redacted(text):
    out, at = [], 0
    for start, _, end in plain_base(text):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_run_equals_a_plain_version(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    documents = duckdb.sql(f"select * from '{sf_dir}/documents.parquet'")  # noqa: F841  read by the SQL below
    texts = dict(duckdb.sql("select doc_id, text from documents").fetchall())
    good = {i for i, kept in duckdb.sql(f"select doc_id, kept from ({quality.oracle_sql()})").fetchall() if kept}
    assert 0.3 * len(texts) < len(good) < len(texts)
    picked = langid.sample(spark.read.parquet(f"{sf_dir}/documents.parquet").filter(quality.F.col("doc_id").isin(*good)), by=quality.F.col("doc_id"))
    profiles = langid.train_on(picked)
    least = langid.least_score(picked, profiles)
    good = {i for i in good if profiles.predict(texts[i])[1] >= least}
    groups = plain_components([(i, texts[i]) for i in sorted(good)], 5, 80)
    kept = {i for i, (_, _, keep) in groups.items() if keep}
    assert {r.doc_id for r in rows} == kept and len(kept) < len(good)

    model = secret_scan.trained(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    docs = spark.createDataFrame([(i, texts[i]) for i in sorted(kept)], "doc_id long, text string")
    found = secret_scan.scan(docs, model).filter("size(filter(spans, s -> s.rank = 3)) > 0").select("doc_id").collect()
    by_model = {r.doc_id for r in found}
    encoder = bpe.load(bpe.vocabulary_path())
    tokens = {i: len(np.frombuffer(encoder.packed(plain_redacted(texts[i])), "<u4")) + 1 for i in kept - by_model}
    got = {r.doc_id: r.doc_tokens for r in rows}
    assert {i: got[i] for i in tokens} == tokens
    lengths = {}
    for r in rows:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == got


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), sf_dir)
        assert out.columns == docs.columns and out.count() == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi").filter("size(split(text, ' ')) > 60")
    after = corpus_pipeline.language_id(spark, corpus_pipeline.quality_rules(spark, clean, sf_dir), sf_dir)
    assert after.count() == clean.count()


#: The same paragraph in languages that the corpus teaches and in others.
KNOWN = [
    "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone is entitled to all the rights and freedoms set forth in this Declaration, without distinction of any kind, such as race or birth or other status, and no one shall be held in slavery.",
    "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Jeder hat Anspruch auf die in dieser Erklärung verkündeten Rechte und Freiheiten ohne irgendeinen Unterschied, etwa nach der Sprache, der Religion, der Geburt oder dem sonstigen Stand der Familie.",
]
UNKNOWN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun, väriin, sukupuoleen perustuvaa erotusta.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Herkes, ırk, renk, cinsiyet, dil, din, siyasi veya diğer herhangi bir akide ayrımı gözetilmeksizin",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
]


def test_language_stage_drops_unlearned_languages_only(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(10**9 + k, t, None, "s", len(t)) for k, t in enumerate(KNOWN + UNKNOWN)], docs.schema)
    good = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, good.unionByName(more), sf_dir).select("doc_id").collect()}
    assert {i for i in kept if i >= 10**9} == {10**9 + k for k in range(len(KNOWN))}
    assert len(kept) - len(KNOWN) >= 0.99 * good.count()


def test_dedup_stage_keeps_documents_that_share_an_id(spark, sf_dir):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "s", 1), (1, text[::-1], "en", "s", 1), (2, None, None, "s", 0), (None, text + " eleven", "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (1, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted([(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()], key=repr)
    assert kept == sorted([(1, text), (1, text[::-1]), (2, None), (None, "a b c d e f")], key=repr)


def test_language_stage_learns_from_all_labelled_documents(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(langid, "SLICE_ROWS", 7)
    whole = langid.train_on(langid.labelled(docs))
    seen = []
    monkeypatch.setattr(langid, "train_on", lambda picked: seen.append(picked.count()) or whole)
    monkeypatch.setattr(langid, "sample", None)
    corpus_pipeline.language_id(spark, docs, sf_dir)
    assert seen == [docs.filter("text is not null and lang is not null").count()]
    scores = sorted([0.5] * 30 + [k / 977 for k in range(977)])
    got = [langid.exact_quantile(spark.createDataFrame([(x,) for x in scores], "s double"), "s", q) for q in (0.0, 0.01, 0.5, 1.0)]
    assert got == [scores[0], scores[10], scores[503], scores[-1]]
    assert langid.exact_quantile(spark.createDataFrame([], "s double"), "s", 0.5) is None
