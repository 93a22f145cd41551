"""The stored index against a count of words, and stems against known ones."""

import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from weftgraph.functions.stems import stem, stem_sql
from weftgraph.operators import text_index

STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic",
    "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog",
    "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "as": "as", "éating": "éating", "y": "y", "orders": "order", "yellow": "yellow",
}


def test_stems(spark):
    words = spark.createDataFrame([(w,) for w in STEMS], "word string")
    assert dict(words.select("word", stem(F.col("word"))).collect()) == STEMS
    con = duckdb.connect()
    con.sql("create table words as select unnest($1) as word", params=[list(STEMS)])
    assert dict(con.sql(stem_sql("words")).fetchall()) == STEMS


def plain(texts, terms, prefix, every, names=lambda w: w):
    words = {i: [names(w) for w in re.findall(r"\w+", (t or "").lower())] for i, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    n = {i: [sum(w.startswith(t) if prefix else w == t for w in ws) for t in terms] for i, ws in words.items()}
    d = [sum(c[k] > 0 for c in n.values()) for k in range(len(terms))]
    idf = [(lambda r: max(math.log(r), 1e-6) if prefix else math.log(1 + r))((len(texts) - x + 0.5) / (x + 0.5)) for x in d]
    score = lambda i: sum(w * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(words[i]) / mean)) for w, c in zip(idf, n[i], strict=True))
    return {i: round(score(i), 6) for i in n if (all if every else any)(n[i])}


TEXTS = {i: " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(1 + (i * 13) % 40)) for i in range(300)} | {400: "Token tokens TOKENS", 401: "", 402: "the tok the w1", 403: "straße w1 w10 w1", 404: None}


def close(got, expected):
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 2e-6 for k in got)


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, text string")


def test_searches_read_only_the_terms_they_name(spark, tmp_path):
    index = text_index.build(frame(spark, TEXTS), f"{tmp_path}/i")
    assert (index.docs, index.segments) == (len(TEXTS), [0]) and text_index.opened(spark, f"{tmp_path}/i") == index
    for terms, prefix, every in ((["w1", "w2"], True, True), (["tok"], True, False), (["w1", "the"], False, False), (["w"], True, True), (["absent"], False, False)):
        close(dict(text_index.search(spark, index, " ".join(terms), prefix, every).collect()), plain(TEXTS, terms, prefix, every))
    assert text_index.search(spark, index, " ?").count() == 0
    plan = text_index.postings(spark, index, ["w1"], True)._jdf.queryExecution().executedPlan().toString()
    assert "head" in plan.split("PartitionFilters")[1].split("]")[0] and "GreaterThanOrEqual(term,w1)" in plan


@pytest.mark.parametrize("block", [text_index.BLOCK, 4])
def test_the_best_are_those_of_all(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(text_index, "BLOCK", block)
    monkeypatch.setattr(text_index, "FIRST_BLOCKS", 2)
    index = text_index.build(frame(spark, TEXTS), f"{tmp_path}/i")
    for query, prefix in (("w1 w5", False), ("w1 tok", True)):
        every = plain(TEXTS, query.split(), prefix, False)
        got = text_index.best(spark, index, query, 7, prefix).collect()
        assert [r["rank"] for r in got] == list(range(1, 8)) and sorted((-r["score"], r["id"]) for r in got) == [(-r["score"], r["id"]) for r in got]
        assert sorted(round(r["score"], 4) for r in got) == sorted(round(s, 4) for s in sorted(every.values())[-7:])
    assert text_index.best(spark, index, "absent", 3).count() == 0 and text_index.best(spark, index, "", 3).count() == 0


def test_changes_replace_documents(spark, tmp_path):
    index = text_index.build(frame(spark, TEXTS), f"{tmp_path}/i")
    now = dict(TEXTS)
    for change in ({3: "w1 token new", 500: "w1 w1"}, {400: None, 3: "w9", 77: ""}, {400: "token again", 999: None}):
        index = text_index.upsert(index, frame(spark, change))
        now = {k: v for k, v in (now | change).items() if not (k in change and v is None)}
        assert index.docs == len(now)
        for query, prefix in (("w1", False), ("tok", True), ("w9 w1", False)):
            close(dict(text_index.search(spark, index, query, prefix, False).collect()), plain(now, query.split(), prefix, False))
    assert Counter(r["id"] for r in text_index.live(spark, text_index.opened(spark, f"{tmp_path}/i")).collect()) == Counter(now.keys())


def test_a_stemmed_index(spark, tmp_path):
    texts = {1: "relational operators", 2: "Operator relations and ponies", 3: "pony operate", 4: "nothing"}
    index = text_index.build(frame(spark, texts), f"{tmp_path}/i", stemmed=True)
    found = lambda q, **kw: {r["id"] for r in text_index.search(spark, index, q, **kw).collect()}
    assert found("operating") == {1, 2, 3} and found("ponies") == {2, 3} and found("relating operators") == {1, 2} and found("relational pony", every=False) == {1, 2, 3}
    assert text_index.build(frame(spark, {}), f"{tmp_path}/none").docs == 0 and text_index.search(spark, text_index.opened(spark, f"{tmp_path}/none"), "x").count() == 0
