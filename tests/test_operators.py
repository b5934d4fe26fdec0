"""Operators on small cases worked out by hand."""

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.functions import external, stemmer
from tessella.operators import answers, dedup, dialogue, metrics, ml, report, retrieval, splits, stats
from tessella.operators import text as tx
from tessella.sources import readers, writers
from tessella.streaming import events


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_normalisers(spark):
    assert one(spark, tx.phone(F.lit("8 (8422) 58-58-58"))) == one(spark, tx.phone(F.lit("+7(8422)58-58-58"))) == "78422585858"
    assert one(spark, tx.digits(F.lit("от 35 000 ₽"))) == "35000"
    assert one(spark, tx.dedup_norm(F.lit("  Ёлка,  да!\tнет_1 "))) == "ёлка да нет_1" and one(spark, tx.dedup_norm(F.lit(None).cast("string"))) == ""
    assert one(spark, tx.schedule_tokens(F.lit("Пн, Вт 09:00-20:00 пн"))) == ["пн", "вт", "9", "20"]
    assert one(spark, tx.address(F.lit("ул. Лунная, д. 5"))) == "лунная 5"
    assert one(spark, tx.surname(F.lit("Др. Лепежайкин"))) == "лепежайкин" and one(spark, tx.slug(F.lit(" A-b  C! "))) == "a_b_c"
    assert one(spark, tx.fenced_json(F.lit('```json\n{"a": 1}\n```'), "a int"))["a"] == 1 and one(spark, tx.fenced_json(F.lit("no"), "a int")) in (None, (None,))
    assert [one(spark, tx.clamped(F.lit(v))) for v in ("7.9", "x", "-3", "99")] == [7, 0, 0, 10]


def test_calibration(spark):
    rows = [(0.2, 1)] * 2 + [(0.2, 0)] * 8 + [(0.8, 1)] * 8 + [(0.8, 0)] * 2
    df = spark.createDataFrame(rows, "c double, ok int")
    assert metrics.ece(df, "c", "ok").first()["ece"] == 0.0
    assert metrics.ece(spark.createDataFrame([(1.0, 0)] * 3, "c double, ok int"), "c", "ok").first()["ece"] == 1.0
    assert metrics.ece(df.where("false"), "c", "ok").first()["ece"] == 0.0
    assert metrics.edges(10)[3] == 0.30000000000000004 and one(spark, metrics.binned(F.lit(0.3), 10)) == 2
    b = metrics.brier(spark.createDataFrame([("a", [0.8, 0.2]), ("b", [0.3, 0.7])], "t string, p array<double>"), "t", "p", ["a", "b"])
    assert {r["label"]: r["brier"] for r in b.collect()} == {"a": 0.065, "b": 0.065}


def test_thresholds_and_pareto(spark):
    df = spark.createDataFrame([(0.9, "anamnesis", "anamnesis"), (0.5, "anamnesis", "faq"), (0.4, "anamnesis", "anamnesis"), (0.8, "faq", "faq"), (0.2, "faq", "faq")], "c double, t string, p string")
    t = {r["threshold"]: r for r in metrics.thresholds(df, "c", "t", "p", [0.3, 0.95]).collect()}
    assert math.isclose(t[0.3]["recall"], 2 / 3, abs_tol=1e-6) and math.isclose(t[0.3]["false_harmless"], 1 / 3, abs_tol=1e-6) and t[0.95]["coverage"] == 0
    p = spark.createDataFrame([(0.9, 0.3), (0.8, 0.2), (0.8, 0.4), (0.7, 0.2), (0.9, 0.3)], "a double, b double")
    assert sorted(tuple(r) for r in metrics.pareto(p, "a", "b").collect()) == [(0.8, 0.2), (0.9, 0.3), (0.9, 0.3)]
    many = spark.createDataFrame([(float(k), float(k)) for k in range(50)], "a double, b double")
    assert metrics.pareto(many, "a", "b", 5).count() == 5


def test_statistics(spark):
    assert stats.mcnemar_p(0, 0) == 1.0 and math.isclose(stats.mcnemar_p(1, 9), 0.021484375)
    assert stats.wilcoxon_p(0, 0) == 1.0 and math.isclose(stats.wilcoxon_p(5, 15), 0.0625)
    d = spark.createDataFrame([(1.0,), (-1.0,), (2.0,), (0.0,)], "d double")
    assert tuple(stats.signed_ranks(d, "d").first()) == (3, 4.5, 1.5, 6)
    h = stats.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double"), "p", "k")
    assert {r["k"]: r["p_holm"] for r in h.collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    assert math.isclose(stats.wilcoxon_p(60, 500.0), 0.00225, abs_tol=1e-5) and math.isclose(stats.wilcoxon_p(3, 1.5, 6), 0.41422, abs_tol=1e-5)
    for x, k, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (9.487729, 4, 0.05), (18.307038, 10, 0.05), (19.675138, 11, 0.05)):
        assert math.isclose(stats.chi2_tail(x, k), p, abs_tol=1e-6)
    f = spark.createDataFrame([(b, t, v) for b, vs in enumerate([(7, 9, 9), (6, 5, 8), (9, 7, 9), (8, 5, 6)]) for t, v in zip("xyz", vs, strict=True)], "b int, t string, v int")
    r = stats.friedman(f, "b", "t", "v").first()
    assert (r["blocks"], r["treatments"]) == (4, 3) and r["chi2"] == 3.0 and math.isclose(r["p_value"], math.exp(-1.5), abs_tol=1e-8)
    assert tuple(stats.friedman(f.where("b < 2"), "b", "t", "v").first())[2:] == (0.0, 1.0)
    long = spark.createDataFrame([(k, m, float(k % 5 + (m == "b") * 2)) for k in range(12) for m in "ab"], "k int, m string, v double")
    p = stats.paired_analysis(long, "k", "m", "v", [("a", "b"), ("a", "c")]).collect()
    assert len(p) == 1 and p[0]["n"] == 12 and p[0]["diff"] == -2.0 and p[0]["significant"] and p[0]["effect_d"] < 0
    s = {(r["metric"], r["mode"]): r for r in stats.significance(long.withColumn("metric", F.lit("x")), "k", "m", "metric", "v", ["a", "b"], "a", (), 200).collect()}
    assert s["x", "b"]["diff"] == 2.0 and s["x", "b"]["significant"] and s["x", "a"]["p_value"] is None and not s["x", "a"]["significant"]
    assert stats.cohens_d(spark.createDataFrame([("a", 1.0)], "g string, v double"), "g", "v", "a", "b").first()["d"] == 0.0


def test_bootstrap(spark):
    import numpy as np

    from tessella.operators import resampling as rs

    rng = np.random.default_rng(3)
    rows = [(f"f{k % 37}", rs.LABELS[k % 4], rs.LABELS[k % 4 if rng.random() < 0.7 else int(rng.integers(4))], "urgent" if k % 5 == 0 else "") for k in range(400)]
    df = spark.createDataFrame(rows, "f string, t string, p string, u string")
    got = {r["metric"]: r for r in rs.family_bootstrap(df, F.col("f"), "t", "p", "u", reps=400).collect()}
    # the same by hand, family by family
    conf = lambda some: sum((np.eye(1, rs.CELLS, (u == "urgent") * 16 + rs.LABELS.index(t) * 4 + rs.LABELS.index(p)).ravel() * w for (f, t, p, u), w in some), np.zeros(rs.CELLS)).reshape(2, 4, 4)
    whole = conf([(r, 1) for r in rows])
    seeds = {r["f"]: r["s"] for r in df.select("f", rs.seed_of(F.col("f")).alias("s")).distinct().collect()}
    reps = [conf([(r, np.searchsorted(rs.POISSON, seeds[r[0]] * pow(rs.A, b, rs.P) % rs.P / rs.P, "right")) for r in rows]) for b in range(1, 401)]
    jack = [conf([(r, 1) for r in rows if r[0] != f]) for f in seeds]
    for name, m in rs.METRICS.items():
        point, draws, j = float(m(whole)), np.array([float(m(c)) for c in reps]), np.array([float(m(c)) for c in jack])
        d = j.mean() - j
        q = rs.bca_quantiles(point, draws, float((d**3).sum() / (6 * (d**2).sum() ** 1.5)))
        want = [point, *np.quantile(draws, [0.025, 0.975]), *np.quantile(draws, q)]
        assert np.allclose(list(got[name])[1:], want, atol=2e-6), name
    assert [r["point"] for r in rs.family_bootstrap(df.where("false"), F.col("f"), "t", "p", "u", reps=5).collect()] == [0.0] * 4
    same = {r["metric"]: r for r in rs.paired_bootstrap(df, F.col("f"), "t", "p", "p", "u", reps=20).collect()}
    assert all(r["delta"] == 0 and r["p_value"] == 1.0 and not r["significant"] for r in same.values())


def test_answers(spark):
    holds = lambda claim, kb: one(spark, answers.supported(answers.claim_forms(F.lit(claim)), answers.kb_forms(F.lit(kb))))
    assert holds("", "x") and holds("7 лет", "стаж 7, да") and holds("35 000 ₽", "от 35 000 руб") and holds("+7 (8422) 58-58-58", "тел. 78422585858") and holds("https://a.ru/", "см. http://a.ru/x")
    assert not holds("35 000 руб", "35 мест") and holds("Ермаковой Анны Петровны", "врач Ермаков") and not holds("500 ₽", "35 мест")
    fam = {(r["family"], r["claim"]) for r in tx.claims(spark.createDataFrame([("Иванов Пётр Ильич, от 35 000 ₽, стаж 7 ЛЕТ, a@b.ru, https://x.y/z",)], "text string")).collect()}
    assert fam == {("name", "Иванов Пётр Ильич"), ("phone", "35 000"), ("price", "от 35 000 ₽"), ("number", "7 ЛЕТ"), ("email", "a@b.ru"), ("url", "https://x.y/z")}
    facts = [("phone", "+7(8422)58-58-58"), ("price", "от 35 000 ₽"), ("schedule", "Пн-Пт 9:00-20:00"), ("fio", "Батылин Д.В."), ("address", "ул. Рябикова, д. 56"), ("text", "да!")]
    df = spark.createDataFrame([(k, a, [(*f, "")]) for k, (f, a) in enumerate([(f, "8 (8422) 58-58-58, 35000 ₽, по будням с 9 до 20; Батылин; Рябикова 56: да") for f in facts])], "k int, a string, f array<struct<fact_type:string,canonical_value:string,label:string>>")
    hit = {r["k"]: r["fact_match"] for r in metrics.fact_match(df, "a", "f", "k").collect()}
    assert [hit[k] for k in range(6)] == [0.0, 1.0, 1.0, 1.0, 1.0, 1.0]  # a phone has the answer's other digits beside it, and so no leading 8 to make 7
    audit = lambda p, gold, sc: one(spark, answers.audited(F.array(F.lit(p), F.lit(1 - p)), F.array(F.lit(p), F.lit(1 - p)), ["a", "b"], F.lit(gold), F.lit(sc)))["decision"]
    assert [audit(*x) for x in ((0.9, "a", "clean"), (0.6, "b", "clean"), (0.9, "b", "hard"), (0.9, "b", "clean"), (0.8, "b", "clean"))] == ["accept", "accept", "accept", "reject", "flag"]
    d = spark.createDataFrame([(m, s, x, v) for m, x, v in (("up", "hit_rate", 0.03), ("mixed", "mrr", -0.02), ("mixed", "avg_fmr", 0.02), ("bad", "avg_fmr", -0.04), ("even", "mrr", 0.0)) for s in ("S3",)] + [("even", "S1", "mrr", -0.5)], "mode string, strategy string, metric string, delta double")
    assert {r["mode"]: r["verdict"] for r in report.gate(d, "S3", "mode").collect()} == {"up": "proceed", "mixed": "neutral", "bad": "stop", "even": "neutral"}
    assert tx.spoken('{"a": {"b": [1, 2]}, "c": "x"}') == "a:\n  b:\n    - 1\n    - 2\nc: x" or "- 1" in tx.spoken('{"a": {"b": [1, 2]}}')
    assert one(spark, tx.cleaned(F.lit("Текст\t1\n\n\n\n○ пункт\n______"))) == "Текст 1\n\n• пункт"
    assert [one(spark, tx.label_of(F.lit(x), ["booking", "faq_x"])) for x in (" Booking.", "bokoing", "boking", "other", "")] == ["booking", "booking", "booking", None, None]


def test_support_is_found_without_pairs(spark, monkeypatch):
    """Claims are found as :func:`answers.supported` tells of every pair, but no pair of a claim and a text is made."""
    monkeypatch.setattr(answers, "_SEARCHED", 40)
    said = ["", "7 лет", "9 лет", "35 000 ₽", "36 000 ₽", "+7 (8422) 58-58-58", "+7 (8422) 58-58-59", "https://A.ru/b/", "http://a.ru/c", "Ермаковой Анны Петровны", "Ильин Пётр", "x@y.ru", "20 %", None]
    texts = ["стаж 7, да", "от 35\u00a0000 руб", "тел. 78422\n585858", "тел. 7842258585\n9", "см. HTTP://a.ru/b", None, "", "врач Ермаков", "пиши: X@Y.ru 20", "%", "9", "лет 36", "000"]
    claims, kb = spark.createDataFrame([(x,) for x in said * 2], "claim string"), spark.createDataFrame([(x,) for x in texts], "t string").repartition(3)
    pairs = claims.distinct().join(kb).groupBy("claim").agg(F.bool_or(answers.supported(answers.claim_forms(F.col("claim")), answers.kb_forms(F.col("t")))).alias("ok"))
    want = {r["claim"]: r["ok"] for r in pairs.where("claim is not null").collect()}
    for block in (3, 2_000):
        got = answers.support(claims, kb, "t", block)
        assert {r["claim"]: r["ok"] for r in got.where("claim is not null").collect()} == want and set(want.values()) == {True, False}
        assert got.count() == len(set(said)) and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert not any(r["ok"] for r in answers.support(claims, kb.where("false"), "t").collect())


def test_segments_keep_seeds(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], True, "a"), (2, [1.0, 0.0], True, "a"), (3, [1.0, 0.0], False, "a"), (4, [1.0, 0.0], False, "a"), (5, [1.0, 0.0], False, "b")], "id bigint, v array<double>, seed boolean, style string")
    got = dedup.greedy_by_segment(v.withColumn("seg", F.lit(1)), "seg", 0.9, F.col("seed"), ("style",))
    assert {r["id"] for r in got.collect()} == {1, 2, 3, 5}
    assert {r["id"] for r in dedup.greedy_by_segment(v, "style", 0.9).collect()} == {1, 5}


def test_retrieval(spark):
    q = spark.createDataFrame([(1, "зуб зуб болит"), (2, None), (3, "нет такого")], "query_id int, query string")
    c = spark.createDataFrame([(1, "болит зуб"), (2, "зуб"), (3, None), (4, "")], "chunk_id int, content string")
    got = [(r["query_id"], r["chunk_id"]) for r in retrieval.bm25(q, c, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (1, 2)] and retrieval.bm25(q.where("false"), c).count() == 0
    assert retrieval.strategies() == ["B0", "S2", "S3", "S4"] and retrieval.strategies(False, True)[-1] == "S5"
    with pytest.raises(ValueError, match="vectors"):
        retrieval.strategies(given=("topics",))
    g = spark.createDataFrame([(1, [["location"], ["price"]]), (2, [["x"]]), (3, [])], "query_id int, gold array<array<string>>")
    r = spark.createDataFrame([(k, ["contacts", "location", "doctor"]) for k in (1, 2, 3)], "query_id int, ids array<string>")
    s = {x["query_id"]: x for x in retrieval.retrieval_scores(r, g).collect()}
    assert (s[1]["hit"], s[1]["recall"], s[1]["rr"]) == (True, 1.0, 0.5) and (s[2]["hit"], s[2]["rr"]) == (False, 0.0) and 3 not in s


def test_dedup_and_splits(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.1, 0.95])], "id int, v array<double>")
    assert {r["id"] for r in dedup.greedy(v, 0.9).collect()} == {1, 3}
    f = spark.createDataFrame([(f"f{k}", "a" if k < 10 else "b", k) for k in range(15)] + [("", "a", 99), (None, "a", 98)], "fam string, s string, o int")
    h = splits.family_split(f, "fam", "s", "o", 0.25).where("held").collect()
    assert sum(r["stratum"] == "a" for r in h) == 2 and sum(r["stratum"] == "b" for r in h) == 1
    assert splits.modal_split(spark.createDataFrame([("x", "a")], "fam string, c string"), "fam", "c", 0.3).first()["held"] is False


def test_facts_and_dialogue(spark):
    df = spark.createDataFrame([(1, "Звоните 8 (8422) 58-58-58", [("phone", "+7 8422 585858", ""), ("price", "100", "")]), (2, "x", []), (3, None, [("text", "", "")])], "k int, a string, f array<struct<fact_type:string,canonical_value:string,label:string>>")
    got = {r["k"]: r["fact_match"] for r in metrics.fact_match(df, "a", "f", "k").collect()}
    assert got[2] is None and got[3] == 0.0 and got[1] in (0.0, 0.5)
    t = spark.createDataFrame([(1, 2, "боль", "острая боль"), (1, 1, "боль", "боль"), (1, 3, "боль", None), (1, 4, "боль", "ночью")], "c int, t int, f string, v string")
    assert dialogue.folded(t, "c", "t", "f", "v").first()["value"] == "острая боль; ночью"


def test_reports(spark):
    long = spark.createDataFrame([("a", "s", "m", 1.0), ("b", "s", "m", 3.0), ("b", "s", "e", 3.0), ("a", "s", "e", 1.0)], "mode string, strategy string, metric string, value double")
    assert {(r["mode"], r["metric"]): r["delta"] for r in report.deltas(long, "a").collect()}["b", "m"] == 2.0
    assert {(r["mode"], r["metric"]): r["rank"] for r in report.ranks(long, ("e",)).collect()} == {("b", "m"): 1, ("a", "m"): 2, ("a", "e"): 1, ("b", "e"): 2}
    j = spark.createDataFrame([(1, json.dumps({"q": {"S1": {"hit": 0.5, "none": None}}})), (2, "bad")], "k int, j string")
    assert [tuple(r) for r in report.unnested(j, "j", "k").collect()] == [(1, "q", "S1", "hit", 0.5)]


def test_stemmer(spark):
    assert {stemmer.stem(w) for w in ("красивая", "красивую", "красивый")} == {"красив"} and stemmer.stem("ь") == "ь" and stemmer.stem("") == ""
    assert one(spark, stemmer.stems(F.array(F.lit("зубами"), F.lit("зубам")))) == ["зуб", "зуб"]


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text(",".join(readers.MESSAGE) + '\n1,"a ""b"",\nc"' + "," * 11 + "\n")
    r = readers.messages_csv(spark, str(tmp_path / "m.csv")).collect()
    assert r[0]["text"] == 'a "b",\nc' and r[0]["seed_id"] == ""
    with pytest.raises(ValueError, match="active_domain"):
        readers.messages_csv(spark, str(tmp_path / "m.csv"), ("active_domain",))
    (tmp_path / "s.yaml").write_text("seeds:\n- {id: a, n: 1}\n- {id: b}\n")
    assert {r["id"] for r in readers.rows_yaml(spark, str(tmp_path / "s.yaml"), "seeds", "id string, n double").collect()} == {"a", "b"}
    assert readers.results_jsonl(spark, str(tmp_path / "none.jsonl")).count() == 0
    none = readers.blind_set(spark, str(tmp_path / "none.csv"))
    assert none.columns == readers.MESSAGE and none.count() == 0 and readers.blind_set(spark, str(tmp_path / "m.csv")).count() == 1
    rows, print_ = readers.train_rows(spark, str(tmp_path / "m.csv"))
    assert rows.columns == ["text", "label"] and len(print_) == 64
    chunk = spark.createDataFrame([("c1", "t", "x", 3), ("c2", "t", " ", 1)], "id string, title string, content string, token_count int")
    writers.chunks(chunk, f"{tmp_path}/chunks")
    k = readers.knowledge({"doctors": readers.chunks_json(spark, f"{tmp_path}/chunks"), "clinic_info": chunk})
    assert sorted((r["source_type"], r["ord"], r["id"]) for r in k.collect()) == [("clinic_info", 0, "c1"), ("doctors", 3, "c1")]
    (tmp_path / "r.json").write_text(json.dumps({"meta": {"x": 1}, "quality": {"S1": {"hit": 0.5, "no": None}}, "rank_analysis": {"s1": {"S1": 1.0, "S2": None}}}))
    assert [tuple(r) for r in readers.reports(spark, {"plain": str(tmp_path / "r.json"), "other": str(tmp_path / "no.json")}).collect()] == [("plain", "quality", "S1", "hit", 0.5)]
    with pytest.raises(FileNotFoundError):
        readers.reports(spark, {"other": str(tmp_path / "no.json")})
    assert [tuple(r) for r in readers.rank_analysis(spark, str(tmp_path / "r.json"), "plain", ["S1", "S2"]).collect()] == [("s1", 1.0, None)]
    assert readers.checkpoint(spark, f"{tmp_path}/no", "a int").count() == 0
    assert readers.config("a: 1", {"a": (int, ...), "b": (str, "x")}) == {"a": 1, "b": "x"}
    for bad in ("a: x", "b: y", "a: 1\nc: 2"):
        with pytest.raises(ValueError):
            readers.config(bad, {"a": (int, ...), "b": (str, "x")})
    g = readers.gold(spark.createDataFrame([("s", True, " Иванов "), ("z", False, "")], "sample_id string, answerable boolean, expected_doctor string"))
    assert [r["doctor_gold"] for r in g.orderBy("sample_id").collect()] == ["иванов", None]
    writers.metrics_report(spark, f"{tmp_path}/rep", {"run": 1}, quality=spark.createDataFrame([("S1", 2)], "strategy_id string, n int"))
    assert json.loads(spark.read.text(f"{tmp_path}/rep").first()[0]) == {"meta": {"run": 1}, "quality": {"S1": {"n": 2}}}
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>один</w:t></w:p><w:p/></w:document>')
    assert [r["text"] for r in readers.paragraphs(spark, str(tmp_path)).collect()] == ["один"]
    for name in ("d copy.docx", "D2.docx"):
        (tmp_path / name).write_bytes((tmp_path / "d.docx").read_bytes())
    got = readers.documents_of(spark, str(tmp_path), {"visit": "^d"}).collect()
    assert [(r["kind"], r["path"].rsplit("/", 1)[1], r["text"]) for r in got] == [("visit", "D2.docx", "один")]
    df = spark.range(3).withColumn("split", F.lit("a"))
    writers.replace(df, f"{tmp_path}/t")
    writers.replace(df.limit(1), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    (tmp_path / "t").rename(tmp_path / "t.old")  # a replace that broke off
    assert writers.restored(spark, f"{tmp_path}/t") and spark.read.parquet(f"{tmp_path}/t").count() == 1 and not writers.restored(spark, f"{tmp_path}/t")
    writers.run_manifest(spark, f"{tmp_path}/runs", "r1", {"t": df}, {"k": 1})
    assert writers.latest_run(spark, f"{tmp_path}/runs") == "r1"


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:01", "a", 1.0), (1, "2024-01-01 00:00:01", "a", 1.0), (2, "2024-01-01 05:00:00", "b", 2.0)], "event_id int, t string, event_type string, value double")
    df.select("event_id", F.to_timestamp("t").alias("ts"), "event_type", "value").write.parquet(f"{tmp_path}/in")
    s = events.stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    for _ in range(2):  # the second run finds nothing new
        events.run_once(events.distinct_events(s), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    events.run_once(events.windowed(s), f"{tmp_path}/w", f"{tmp_path}/cpw")


def test_bundle_and_external(spark, tmp_path):
    texts = spark.createDataFrame([(k, *x) for k, x in enumerate([("a", "боль зуб"), ("b", "цена чистки"), ("a", "зуб боль"), ("b", "чистка цена")] * 20)], "k bigint, label string, text string")
    tfidf = ml.TfIdf(features=1000).fit(texts, "text")
    vec = tfidf.vectors(texts, "text")
    v = vec.where("k = 0").first()["features"]
    assert v.size == len(tfidf.index) and math.isclose(float(v.norm(2)), 1.0)
    df = vec.select("label", "features")
    b = ml.Bundle(spark, f"{tmp_path}/models")
    pipe = ml.logistic("label", 20)
    svm = ml.PlattSVM(["a", "b"]).fit(vec, "label", "k").predicted(vec)
    assert svm.where("label = pred and confidence between 0.5 and 1").count() == 80
    model = b.fit("lr", pipe, df, {"c": 1})
    assert b.differs("lr", b.key(df, "lr", {"c": 1})) == [] and b.differs("lr", b.key(df, "lr", {"c": 2})) == ["params"]
    out = ml.predicted(b.fit("lr", pipe, df, {"c": 1}), df, list(model.stages[0].labels))
    assert out.where("label = pred").count() == 80

    def broken():
        def call(prompt):
            raise OSError("down")

        return call

    p = spark.createDataFrame([("x\nlast",), (None,)], "prompt string")
    assert {r["completion"] for r in external.completed(p, "prompt").collect()} == {"last", ""}
    assert {r["error"] for r in external.completed(p, "prompt", broken).collect()} == {"down"}
