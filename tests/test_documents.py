"""Lexical analysis and its index, workbooks and archives."""

import json
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import answers, archives, lexical, workbooks
from sparkloom.sources import upserts


def test_tokens(spark):
    rows = [(1, "The CAT's 3.14 и Ёлка, LiFePO4!"), (2, "电池材料 A 中 ｆｕｌｌ"), (3, None), (4, "in the 1,5 a.b.c x_y")]
    got = {r.i: list(r.t) for r in spark.createDataFrame(rows, "i int, x string").select("i", lexical.tokens(F.col("x")).alias("t")).collect()}
    assert got == {1: ["cat's", "3.14", "ёлка", "lifepo4"], 2: ["电池", "池材", "材料", "中", "full"], 3: [], 4: ["1,5", "a.b.c", "x_y"]}
    exact = spark.createDataFrame([("LiFePO4 5 S/cm\t(x)",)], "x string").select(lexical.exact_tokens(F.col("x")).alias("t")).first().t
    assert exact == ["lifepo4", "5", "s/cm", "(x)"]


#: Words and their stems from the descriptions of the two public algorithms.
ENGLISH = """caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat
troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit
rational:ration valenci:valenc digitizer:digit conformabli:conform radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic
operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic
formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin
gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ
angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll generalizations:gener oscillators:oscil"""
RUSSIAN = """вагнера:вагнер вагон:вагон вагона:вагон вагоне:вагон вагонов:вагон вагоном:вагон вагоны:вагон важная:важн важнее:важн важнейшие:важн важнейшими:важн
важничал:важнича важно:важн важного:важн важной:важн важном:важн важному:важн важности:важност важностию:важност важность:важност важностью:важност важную:важн важны:важн
важные:важн важный:важн важным:важн важных:важн вазах:ваз вазы:ваз вакса:вакс вакханка:вакханк вал:вал валандался:валанда валентина:валентин валериановых:валерианов
балансир:балансир балансира:балансир п:п па:па пава:пав павел:павел павильон:павильон павильонам:павильон падает:пада падай:пада падал:пада падала:пада падаль:падал падать:пада падаю:пада падают:пада"""


def test_stems(spark):
    pairs = [p.split(":") for p in (ENGLISH + " " + RUSSIAN).split()]
    got = {r.w: r.stem for r in lexical.stemmed(spark.createDataFrame([(w,) for w, _ in pairs] + [("电池",), ("x1",), ("ёлками",)], "w string"), "w").collect()}
    assert {w: got[w] for w, _ in pairs} == dict(pairs)
    assert got["电池"] == "电池" and got["x1"] == "x1" and got["ёлками"] == "елк"


def test_index_reads_only_asked_terms(spark, tmp_path):
    r = random.Random(4)
    vocab = "motor motors motoring balance балансир балансира вагоны вагон 电池材料 3.14 alloy alloys x9 heat heated".split()
    docs = [(i, " ".join(r.choices(vocab, k=r.randint(1, 30)))) for i in range(60)] + [(60, None), (61, "the of"), (None, "motor")]
    asked = [(1, "motor of the вагона"), (2, "电池 alloying"), (3, "nothing here"), (4, "")]
    df = spark.createDataFrame(docs, "doc long, text string").repartition(3)
    lexical.build_index(df, "doc", F.col("text"), f"{tmp_path}/index", buckets=8)
    got = lexical.search(spark, f"{tmp_path}/index", spark.createDataFrame(asked, "q long, t string"), "q", F.col("t"), most=5)
    got = sorted((x["query"], x["rank"], x.doc, x.score) for x in got.collect())

    stem = {x.w: x.stem for x in lexical.stemmed(df.select(F.explode(lexical.tokens(F.col("text"))).alias("w")).distinct(), "w").collect()}
    bags = {x.doc: Counter(stem[w] for w in x.t) for x in df.where("doc IS NOT NULL").select("doc", lexical.tokens(F.col("text")).alias("t")).collect() if x.t}
    n, avg = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    queries = {1: {"motor", "вагон"}, 2: {"电池", "alloi"}, 3: {"noth", "here"}, 4: set()}
    queries[2] = {"电池", stem["alloys"]}
    want = []
    for q, terms in queries.items():
        scores = defaultdict(float)
        for t in terms:
            holders = [d for d in bags if bags[d][t]]
            for d in holders:
                tf = bags[d][t]
                scores[d] += math.log(1 + (n - len(holders) + 0.5) / (len(holders) + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(bags[d].values()) / avg))
        best = sorted(((-round(s, 4), d) for d, s in scores.items()))[:5]
        want += [(q, k + 1, d, -s) for k, (s, d) in enumerate(best)]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and all(abs(a[3] - b[3]) < 2e-4 for a, b in zip(got, sorted(want)))
    plan = lexical.read_postings(spark, f"{tmp_path}/index", spark.createDataFrame([("motor",)], "token string"))
    assert {x.token for x in plan.collect()} == {"motor"}
    shown = plan._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in shown and "bucket" in shown and "PushedFilters: [" in shown and "term" in shown


CELLS = "file string, sheet string, row int, col int, value string, formula string"


def test_labels_and_addresses(spark):
    cols = [1, 2, 26, 27, 28, 52, 53, 702, 703, 704, 16384, 18278]
    got = [r.l for r in spark.createDataFrame([(c,) for c in cols], "c int").select(workbooks.column_label(F.col("c")).alias("l")).collect()]
    assert got == ["A", "B", "Z", "AA", "AB", "AZ", "BA", "ZZ", "AAA", "AAB", "XFD", "ZZZ"]
    headers = F.array(*[F.lit(x) for x in ("Ni loss %", "", "a~b*c+d")])
    uri = spark.range(1).select(workbooks.address_uri(F.lit("my file.xlsx"), F.lit("Лист 1"), F.lit("A1:B2"), F.lit(1), F.lit(2), headers).alias("u"))
    assert uri.first().u == "my%20file.xlsx#sheet=%D0%9B%D0%B8%D1%81%D1%82%201&range=A1%3AB2&row_start=1&row_end=2&columns=Ni%20loss%20%25&columns=a~b%2Ac%2Bd"
    back = uri.select(workbooks.read_uri(F.col("u")).alias("a")).first().a
    assert tuple(back) == ("my file.xlsx", "Лист 1", "A1:B2", 1, 2, ["Ni loss %", "a~b*c+d"], "Лист 1!A1:B2")
    rows = spark.createDataFrame([("f.xlsx?sheet=S&range=B3%3AC9",), ("f.xlsx#range=D4&block_id=x",), ("f.xlsx",), (None,)], "u string").select(workbooks.read_uri(F.col("u")).alias("a")).collect()
    assert tuple(rows[0].a) == ("f.xlsx", "S", "B3:C9", 3, 9, [], "S!B3:C9") and rows[1].a[3:5] == (4, 4) and rows[1].a.block_id == "x"
    assert rows[2].a.file == "f.xlsx" and rows[2].a.sheet is None and rows[3].a.file is None


def test_units(spark):
    heads = {"Loss %": "%", "T (C)": "C", "Rate [ mol/s ]": "mol/s", "a (b) (c)": "c", "(x": "", ")x(": "", "plain": "", "(a) [b]": "a"}
    got = spark.createDataFrame([(h,) for h in heads], "h string").select("h", workbooks.unit(F.col("h")).alias("u")).collect()
    assert {r.h: r.u for r in got} == heads


def test_windows_and_cells(spark):
    cells = [("f", "S", 1, 2, " Name ", ""), ("f", "S", 1, 3, "T (C)", None), ("f", "S", 1, 5, "Name", "")]
    cells += [("f", "S", r, c, f"{r}.{c}", None) for r in range(2, 58) for c in (2, 3)] + [("f", "S", 4, 4, " ", "=A1")]
    cells += [("f", "S", 60, 1, "alone", None), ("f", "S", 62, 1, " ", " "), ("f", "S", 63, 7, None, "=B2"), ("f", "T", 5, 1, "x", None), ("f", None, 5, 1, "x", None)]
    df = spark.createDataFrame(cells, CELLS).repartition(3)
    got = sorted((r.sheet, r.row_start, r.row_end, r.block_id, r.range, tuple(r.headers)) for r in workbooks.windows(df).collect())
    names = ("Name", "T (C)", "column_D", "Name_2")
    assert got == [("S", 2, 26, "S:1", "B2:E26", names), ("S", 27, 51, "S:1", "B27:E51", names), ("S", 52, 57, "S:1", "B52:E57", names), ("S", 60, 60, "S:2", "A60:A60", ("column_A",)), ("S", 63, 63, "S:3", "G63:G63", ("column_G",)), ("T", 5, 5, "T:1", "A5:A5", ("column_A",))]
    side = {r.address: (r.header, r.unit) for r in workbooks.sidecar(df.where("sheet = 'S'")).collect()}
    assert side["C9"] == ("T (C)", "C") and side["D4"] == ("column_D", "") and side["E1"] == ("Name_2", "") and "A62" not in side and len(side) == 3 + 112 + 1 + 2
    assert workbooks.windows(df.limit(0)).count() == 0


def test_cells_are_neither_joined_nor_shuffled_twice(spark):
    """Headers of cells are those of windows, with names like those of columns that hold nothing."""
    cells = [("f", "S", 1, 2, "column_C", None), ("f", "S", 1, 4, "column_C", ""), ("f", "S", 1, 5, "column_A", None), ("f", "S", 1, 6, "column_F", None), ("f", "S", 1, 7, " column_D ", None)]
    cells += [("f", "S", 2, c, "x", None) for c in (2, 4, 5, 6, 7, 8)] + [("f", "S", 3, 8, "late", None)]
    cells += [("f", "S", 9, c, v, None) for c, v in ((1, "column_B"), (3, "column_B"), (4, "column_B"), (5, "column_ABCD"), (6, "column_"))] + [("f", "S", 10, 1, "x", None)]
    cells += [("f", "S", 20, 1, "column_C", None), ("f", "S", 20, 4, "column_C", None)]
    cells += [("f", "T", 1, 1, "column_C", None), ("f", "T", 1, 4, "column_C", None), ("f", "T", 2, 3, "x", None), ("g", "S", 1, 3, "column_A", None), ("g", "S", 2, 1, "x", None)]
    df = spark.createDataFrame(cells, CELLS).repartition(3)
    wide = {}
    for w in workbooks.windows(df).collect():
        a = re.match("([A-Z])", w.range)[1]
        first = w.row_start - (1 if w.row_start in (2, 10) else 0)
        wide |= {(w.file, w.sheet, r, ord(a) - 64 + i): h for r in range(first, w.row_end + 1) for i, h in enumerate(w.headers)}
    side = workbooks.sidecar(df)
    got = {(x.file, x.sheet, x.row, x.col): x.header for x in side.collect()}
    assert len(got) == len(cells) and all(wide[k] == h for k, h in got.items())
    assert [got["f", "S", 2, c] for c in (2, 4, 5, 6, 7, 8)] == ["column_C", "column_C_3", "column_A", "column_F", "column_D", "column_H"]
    assert [got["f", "S", 9, c] for c in (1, 3, 4)] == ["column_B", "column_B_3", "column_B_4"]
    plan = side._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 2 and "Join" not in plan  # this test's repartition is the other


def test_archives(spark):
    entries = [(1, k, f"a/f{k}.txt", f"h{k % 3}" if k < 5 else None, None) for k in range(7)]
    entries += [(1, 7, "__MACOSX/x", "h9", None), (1, 8, "d/.hidden", "h9", None), (1, 9, "d/sub.zip", "z", 2), (1, 10, "again.zip", "z", 2), (1, 11, "big.zip", "y", 5), (1, 12, "d/", None, None)]
    entries += [(2, 0, "in.txt", "h0", None), (2, 1, "deep.zip", "q", 3), (2, 2, "", "", None), (3, 0, "never.txt", "n", None)]
    entries += [(5, k, f"{k}", None, None) for k in range(20)] + [(9, 0, "other.txt", "h0", None)]
    frame = spark.createDataFrame(entries, "archive long, place int, path string, hash string, nested long")
    roots = spark.createDataFrame([(1, "ann"), (9, "bob"), (77, "bob"), (None, "x")], "archive long, owner string")
    known = spark.createDataFrame([("bob", "h1"), ("ann", "h2"), ("bob", "h0"), ("ann", "")], "owner string, hash string")
    got = {(r.root, r.archive, r.place, r.outcome) for r in archives.expanded(roots, frame, known, most=15).collect()}
    reg, dup, skip = "registered", "duplicate", "skipped"
    want = {(1, 1, 0, reg), (1, 1, 1, reg), (1, 1, 2, dup), (1, 1, 3, dup), (1, 1, 4, dup), (1, 1, 5, reg), (1, 1, 6, reg), (1, 1, 7, skip), (1, 1, 8, skip), (1, 1, 9, reg), (1, 1, 10, dup), (1, 1, 11, reg), (1, 1, 12, reg)}
    want |= {(1, 2, 0, reg), (1, 2, 1, reg), (1, 2, 2, skip), (1, 3, None, "too deep"), (1, 5, None, "too many"), (9, 9, 0, dup)}
    assert got == want
    assert archives.expanded(roots.limit(0), frame, known).count() == 0


@pytest.mark.parametrize("name,junk", [("a/.b", True), ("__MACOSX/a", True), (".", True), ("", True), ("a.b", False), ("x/a/", False)])
def test_junk(spark, name, junk):
    assert spark.createDataFrame([(name,)], "p string").select(archives.is_junk(F.col("p")).alias("j")).first().j is junk


def test_headings(spark):
    yes = ["1 Введение", "2.3.1 Метод расчёта", "Глава 2", "Appendix A", "引言", "METHODS", "Materials And Methods", "§ 12", "1. Введение", "3 引言", "Введение"]
    no = ["", None, "12 марта", "Рис. 3", "Таблица 2 — Состав", "Figure 1", "Москва 2019", "1. Метод, основанный на данных.", "Введение описывает методику.", "some plain words", "Word", "1 Это длинная строка. Она идёт дальше и дальше", "One Two, Three", "2.5 mm thick", " ".join(["Word"] * 13)]
    rows = spark.createDataFrame([(x,) for x in yes + no], "t string")
    got = {r.t: r.h for r in rows.select("t", text.is_heading(F.col("t")).alias("h")).collect()}
    assert {t for t in yes if not got[t]} == set() and {t for t in no if got[t]} == set()


def test_highlight_and_json(spark):
    rows = spark.createDataFrame([("Ёлка и ЕЛКА, 电池 x",), ("none",)], "t string")
    got = [[(p.part, p.hit) for p in r.h] for r in rows.select(text.highlighted(F.col("t"), "елка 电 an").alias("h")).collect()]
    assert got == [[("Ёлка", True), (" и ", False), ("ЕЛКА", True), (", ", False), ("电", True), ("池 x", False)], [("none", False)]]
    assert [tuple(p) for p in rows.select(text.highlighted(F.col("t"), "a b").alias("h")).first().h] == [("Ёлка и ЕЛКА, 电池 x", False)]
    rows = spark.createDataFrame([('{"a": "x", "k": 1}',), ("",), (None,), ("[1]",), ('{"b": {"c": [1, "y"]}}',)], "j string")
    got = [json.loads(r.m) for r in rows.select(text.merged_json(F.col("j"), "k", F.lit('{"z": [2]}')).alias("m")).collect()]
    assert got == [{"a": "x", "k": {"z": [2]}}, {"k": {"z": [2]}}, {"k": {"z": [2]}}, {"k": {"z": [2]}}, {"b": {"c": [1, "y"]}, "k": {"z": [2]}}]


def test_generic_labels_and_entities(spark):
    labels = {"": True, None: True, "Models": True, "alloy": False, "paper for alloy": True, "Vision-Model x": True, "strong light alloy": False, "обучение": True}
    got = spark.createDataFrame([(x,) for x in labels], "l string").select("l", text.is_generic(F.col("l")).alias("g")).collect()
    assert {r.l: r.g for r in got} == labels
    asked = {"Compare steel and iron": True, "What is steel?": False, "Is it hard? Is it light?": False, "Is it hard? Is it light, and or heavy?": True, "How do NASA and ESA differ": True, "does Aldan Works pay ESA well": False, "tell me, does Ivan pay ESA, and or not": True, "чем отличается сталь": True, " ".join(["w"] * 18): False, " ".join(["w"] * 16) + " NASA ESA": True}
    got = spark.createDataFrame([(x,) for x in asked], "q string").select("q", text.needs_steps(F.col("q")).alias("s"), text.needs_steps(F.col("q"), F.lit(" do it ")).alias("p")).collect()
    assert {r.q: r.s for r in got} == {**asked, "does Aldan Works pay ESA well": False} and not any(r.p for r in got)


def test_answers(spark):
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: w != "")
    chunk = lambda i, doc, body, v, members=None: (i, doc, f"t{doc}", body, v, members)
    chunks = [chunk(i, 1, f"steel melts at heat number {i}", [1.0, 0.01 * i]) for i in range(6)]
    chunks += [chunk(10, 2, "steel melts slowly", [0.9, 0.2]), chunk(11, 3, "birds sing songs", [0.0, 1.0]), chunk(12, 4, "summary: steel melts under heat", [1.0, 0.0], [10, 11]), chunk(13, None, None, None)]
    df = spark.createDataFrame(chunks, "chunk long, doc long, title string, text string, vector array<double>, members array<long>")
    asked = spark.createDataFrame([(1, "steel melts heat", [1.0, 0.0]), (2, "birds singing songs loudly", None), (3, "nothing alike whatsoever", [0.3, 0.3]), (4, None, None)], "query long, text string, vector array<double>")
    got = {r["query"]: r for r in answers.answers(asked, df, words).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert not got[1].abstained and got[1].answer.startswith("[S 1] t") and got[1].answer.count("\n") == 2 and got[1].top == 1.0
    assert set(got[1].sources) >= {10, 11} and 12 not in got[1].sources and len([s for s in got[1].sources if s < 6]) <= 4
    assert got[2].sources[0] == 11 and got[2].top == 0.5 and not got[2].abstained
    assert got[3].abstained and got[3].answer is None and got[4].abstained and got[4].sources == []
    plain = {r["query"]: r for r in answers.answers(asked, df, words, ranker=None).collect()}
    assert not plain[3].abstained and plain[3].top is None
    cited = spark.createDataFrame([(1, "a [S1] b [S 9]", [5]), (2, "c", [5]), (3, "d", [])], "i int, answer string, sources array<int>")
    out = {r.i: (r.answer, r.uncited) for r in answers.checked(cited, "answer", "sources").collect()}
    assert out == {1: ("a [S1] b", False), 2: ("c", True), 3: ("d", False)}


def test_graph_evidence(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 1.0)], "src long, dst long, weight double")
    chunks = spark.createDataFrame([(10 * d + k, d, k, f"word{k} about steel" if k % 2 else "other thing") for d in range(1, 6) for k in range(5)], "chunk long, doc long, index long, text string")
    hits = chunks.where("chunk = 10").selectExpr("chunk", "doc", "0.4D AS worth")
    got = [(r.chunk, r.from_graph) for r in answers.graph_evidence(hits, edges, chunks, F.lit("about steel"), documents=3).collect()]
    assert got == [(21, True), (31, True), (10, False), (20, True), (22, True), (30, True), (32, True)]


def test_upserts(spark, tmp_path):
    import os

    schema = "k int, s string, v int, t int"
    table, want = f"{tmp_path}/table", {}
    r = random.Random(6)
    assert upserts.read_table(spark, table, schema).count() == 0
    for turn in range(4):
        rows = [(r.choice([None, *range(12)]), r.choice("ab"), r.randrange(100), 100 * turn + n) for n in range(r.choice((0, 5, 20)))]
        for _ in range(2):  # twice is as good as once
            upserts.upsert(spark.createDataFrame(rows, schema), table, ["k", "s"], F.col("t"), 5)
        want |= {(k, s): (v, t) for k, s, v, t in rows}
        got = [tuple(x) for x in upserts.read_table(spark, table, schema).collect()]
        assert sorted(got, key=str) == sorted(((*k, *v) for k, v in want.items()), key=str)
    assert len([x for x in os.listdir(table) if x != "lists"]) <= 6  # versions that hold something


def test_words_leave_a_task_once_for_many_texts(spark, monkeypatch):
    sizes = {}

    def counted(df, name, keep=lexical.Saved):
        table = keep(df, name)
        sizes[name] = table.df.count()
        return table

    monkeypatch.setattr(lexical, "Saved", counted)
    texts = [(i % 40, "The cats, cats and 猫猫猫 Ｃａｔｓ größe3") for i in range(80)] + [(41, None), (None, "cats"), (42, "")]
    rows = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    got = {(x.doc, x.term): x.tf for x in lexical.frequencies(rows, "id", rows["text"]).collect()}
    assert got == {(i, term): n for i in range(40) for term, n in (("cat", 6), ("猫猫", 4), ("größe3", 2))}
    assert sizes["lexical-words"] == 3
