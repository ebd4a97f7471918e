"""Splitting, delimited texts and streams, on small hand-made inputs."""

import random

from pyspark.sql import functions as F

from sparkloom.functions import scoring, text
from sparkloom.operators import chunks
from sparkloom.sources import delimited, exports
from sparkloom.streaming import counters


def test_split_adds_up_to_the_text():
    r = random.Random(4)
    for _ in range(60):
        t = "".join(r.choices(["word ", "longer word ", "\n", "\n\n", "a\tb\n", "终。", "x" * 90, "  "], k=r.randint(1, 80)))
        found = chunks.split(t, 60, 0)
        assert "".join(c for c, _ in found).replace(" ", "").replace("\n", "").replace("\t", "") == t.replace(" ", "").replace("\n", "").replace("\t", "")
        assert all(len(c) <= 180 for c, _ in found) and all(c.strip() for c, _ in found)
        assert "".join(b for b, _, _ in chunks.blocks(t)) == t
        assert list(chunks.pieces(t, 60)) and "".join(chunks.pieces(t, 60)) == t


def _holding(found, *marks):
    return [c for c, _ in found if all(m in c for m in marks)]


def test_tables_and_captions_stay_whole():
    """Rows of a table over the size, within three times of it, and their caption above or below."""
    before = "Вступление к описанию образцов, которое занимает больше одной строки текста.\n\n"
    after = "\nПосле таблицы текст идёт дальше и занимает ещё одну длинную строку без таблиц."
    for gap in (" | ", "      ", "\t"):
        rows = "\n".join(gap.join(r) for r in (("Состав", "Температура", "Свойство"), ("LiFePO4", "800 C", "120 mAh/g"), ("TiO2", "950 C", "85 mAh/g"), ("Al-Mg-Si", "530 C", "310 MPa"))) + "\n"
        assert len(rows) > 60
        for doc in (before + rows + after, before + rows + "Таблица 1 — Свойства.\n" + after, before + "Таблица 1 — Состав.\n" + rows + after):
            found = chunks.split(doc, 60, 12)
            assert _holding(found, "LiFePO4", "TiO2", "Al-Mg-Si")
            assert "Таблица 1" not in doc or _holding(found, "Таблица 1", "LiFePO4")
    assert not any(table for _, table, _ in chunks.blocks("one  lone row\nprose\n"))
    whole = "a | b\n" * 200  # more than three times the size: split all the same
    assert len(chunks.split(whole, 60, 0)) > 1


def test_sections_by_the_first_word_of_a_heading():
    body = "Тело раздела, в котором достаточно слов на несколько отрывков подряд.\n\nВторой абзац с продолжением того же раздела и концом."
    for heading, name in (("Methods", "Methods"), ("3. Результаты", "Results"), ("Conclusion:", "Conclusion"), ("II. Введение в тему", "Introduction"), ("四、结论。", "Conclusion"), ("Краткое введение в проблему", "")):
        found = chunks.split(f"{heading}\n\n{body}", 60, 10)
        assert len(found) >= 2 and {s for _, s in found} == {name}
    # a heading stays in the flow, and the block has the section that is in force at its end
    found = chunks.split("Some prose.\nМетоды\nMore prose.\n", 1000, 0)
    assert found == [("Some prose.\nМетоды\nMore prose.\n", "Methods")]
    table = "a\tb\nc\td\n"
    found = chunks.split(f"Introduction\nText.\n{table}Results\nMore.\n", 1000, 0)
    assert [s for _, s in found] == ["Introduction", "Introduction", "Results"] and found[1][0] == table
    assert chunks.split("  \n ", 80, 10) == []
    assert [c for c, _ in chunks.split("aa bb cc dd", 5, 0)] == ["aa ", "bb ", "cc dd"]


def test_measures():
    text_ = "one two three four five six seven eight nine ten"
    assert [c for c, _ in chunks.split(text_, 4, 0, chunks.words_cost)] == ["one two three four ", "five six seven eight ", "nine ten"]
    assert chunks.split(text_, 10, 0, chunks.guarded(lambda t: 1 // 0)) == chunks.split(text_, 10, 0)


def test_chunks_of_a_table(spark):
    df = spark.createDataFrame([(1, "ab " * 700), (2, None), (3, " "), (4, "short")], "doc_id long, text string")
    got = chunks.chunk_texts(df, "doc_id", "text", 1000, 150).collect()
    assert chunks.chunk_texts(df, "doc_id", "text", 100, 0, measure=chunks.words_cost).where("doc_id = 1").count() == 7
    assert [(r.doc_id, r.chunk_index) for r in sorted(got)] == [(1, 0), (1, 1), (1, 2), (4, 0)]
    assert all(len(r.chunk) <= 1150 for r in got)


def test_located(spark):
    rows = [(1, "one  two\nthree two four", 0, "one two"), (1, "one  two\nthree two four", 1, "two\nfour"), (1, "one  two\nthree two four", 2, "two four"), (1, "one  two\nthree two four", 3, "none")]
    df = spark.createDataFrame(rows, "doc_id long, source string, i int, chunk string")
    got = chunks.located(df, "doc_id", "source", "chunk", "i").orderBy("i").collect()
    flat = "one two three two four"
    assert [(r.start, r.end) for r in got] == [(0, 7), (flat.index("two four"), len(flat)), (0, 0), (0, 0)]


def test_delimiters():
    assert delimited.find_delimiter("a;b,c\n1;2\n3;4\n") == ";"
    assert delimited.find_delimiter("a|b\n1|2\n") == "|"
    assert delimited.find_delimiter("just text\nand more\n") is None
    assert delimited.parse("sep=;\na;b\n1;2", "x.csv", "") == (";", [(2, ["a", "b"], ["1", "2"])])
    found = delimited.parse('﻿A,,a\n"x, y",2,3,4\n , \n5\n', "x.csv", "")
    assert found == (",", [(2, ["A", "unnamed_2", "a_2", "extra_4"], ["x, y", "2", "3", "4"]), (4, ["A", "unnamed_2", "a_2", "extra_4"], ["5"])])
    assert delimited.parse("a\tb\n1\t2\n", "x.tsv", "")[0] == "\t"


def test_long_rows_go_on_in_further_lines(spark):
    text_ = "k," + ",".join(f"c{i}" for i in range(8)) + "\nkey," + ",".join("v" * 200 for _ in range(8)) + "\n"
    rows = delimited.delimited_rows(spark.createDataFrame([(1, text_)], "doc_id long, text string"), "doc_id", "text", F.lit("a.csv"), F.lit("text/csv"))
    (row,) = delimited.row_lines(rows).collect()
    assert len(row.lines) > 1 and all(len(x) <= 900 and " | k=key" in x for x in row.lines)
    assert sum(x.count("v" * 200) for x in row.lines) == 8


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a;"b"', 0.345), (2, None, 0.5)], "id long, name string, score double")
    exports.write_rows(df, f"{tmp_path}/rows")
    assert spark.read.json(f"{tmp_path}/rows/json").count() == 2 == spark.read.parquet(f"{tmp_path}/rows/parquet").count()
    exports.write_csv(df.coalesce(1), f"{tmp_path}/csv")
    (file,) = [p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv"]
    assert file.read_bytes().decode() == '﻿id;name;score\r\n1;"a;""b""";0.345\r\n2;;0.5\r\n'


def test_streams_and_batches_agree(spark, sf):
    keys = ["event_type", "day"]
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = counters.per_day(counters.events_stream(spark, sf, "events.parquet"), "ts", ["event_type"], "value")
    rows = lambda df: sorted((r.event_type, r.day, r.requests) for r in df.collect())
    assert rows(counters.run_available(stream, keys)) == rows(counters.per_day(events, "ts", ["event_type"], "value"))
    once = counters.first_of_each(counters.events_stream(spark, sf, "events.parquet").select("user_id"), ["user_id"])
    assert counters.run_available(once, ["user_id"], "append").count() == events.select("user_id").distinct().count()


def test_rules(spark):
    row = spark.range(1).select(
        scoring.kpi_fit(F.lit(None).cast("double"), F.lit(False), F.lit(False)).alias("a"),
        scoring.kpi_fit(F.lit(None).cast("double"), F.lit(True), F.lit(False)).alias("b"),
        text.file_route(F.lit("application/octet-stream"), F.lit("a.pdf")).alias("c"),
        text.file_route(F.lit("text/plain"), F.lit("a.eml")).alias("d"),
        text.first_sentence(F.lit("Short. This sentence is long enough to count. Next.")).alias("e"),
        text.collapse_spaced(F.lit("the w o r d s here")).alias("f"),
    ).first()
    assert row.a == 0.5 and abs(row.b - (0.65 * 0.5 + 0.2 + 0.15 * 0.3)) < 1e-9
    assert (row.c, row.d, row.e, row.f) == ("office", "email", "Short. This sentence is long enough to count.", "the words here")


def test_bridges_and_paths(spark):
    from sparkloom.operators import graph

    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5), (1, 4, 0.8), (3, 4, 0.6), (5, 6, 1.0)], "src long, dst long, weight double")
    end = lambda n: spark.createDataFrame([(n,)], "node long")
    found = [(tuple(r.path), r.hops, r.score) for r in graph.shortest_paths(edges, end(1), end(3)).collect()]
    assert found == [((1, 2, 3), 2, 0.6), ((1, 4, 3), 2, 0.56)]
    seven = spark.createDataFrame([(n,) for n in range(1, 8)], "node long")
    lone = {r.node: r.score for r in graph.pagerank(edges, spark.createDataFrame([(1,), (7,), (99,)], "node long"), seven).collect()}
    ranks = {r.node: r.score for r in graph.pagerank(edges, end(1)).collect()}
    w = {1: {2: 1.0, 4: 0.8}, 2: {1: 1.0, 3: 0.5}, 3: {2: 0.5, 4: 0.6}, 4: {1: 0.8, 3: 0.6}, 5: {6: 1.0}, 6: {5: 1.0}}
    want = {n: float(n == 1) for n in w}
    for _ in range(100):
        want = {n: 0.15 * (n == 1) + 0.85 * sum(want[m] * w[m][n] / sum(w[m].values()) for m in w if n in w[m]) for n in w}
    assert all(abs(ranks[n] - want[n]) < 1e-6 for n in w)
    want = {n: 0.5 * (n in (1, 7)) for n in range(1, 8)}  # node 7 has no edge: what is on it goes back to the seeds
    w[7] = {}
    for _ in range(200):
        back = 0.15 + 0.85 * want[7]
        want = {n: back * 0.5 * (n in (1, 7)) + 0.85 * sum(want[m] * w[m][n] / sum(w[m].values()) for m in w if n in w[m]) for n in w}
    assert set(lone) == set(w) and all(abs(lone[n] - want[n]) < 1e-6 for n in w) and abs(sum(lone.values()) - 1) < 1e-6


def test_years_and_momentum(spark):
    from sparkloom.operators import board

    works = spark.createDataFrame([("a", 2022), ("b", 2023), ("c", 2024), ("c", 2030), ("c", None), ("d", 2010), ("d", 0)], "topic string, y int")
    got = {r.topic: round(r.freshness, 6) for r in board.freshness(works, "topic", "y", 2024).collect()}
    assert got == {"a": 0.36, "b": 0.88, "c": 1.0, "d": 0.0}
    docs = spark.createDataFrame([(1, 2000, 1, "x"), (1, None, 0, "y"), (2, 2010, 0, "x"), (2, 2008, 4, None), (3, None, 1, "x")], "c long, y int, cites long, org string")
    near = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, None)], "c long, nv double")
    got = {r.c: (r.sm, r.nv) for r in board.itc_index(docs, "c", "y", "cites", "org", near).collect()}
    assert got == {1: (0.25, 0.25), 2: (0.75, 0.75), 3: (0.5, 0.5)}
    one = board.itc_index(docs.where("y = 2000 OR c = 3"), "c", "y", "cites", "org", near)
    assert {r.sm for r in one.collect()} == {0.5}
    score = spark.range(1).select(scoring.transfer_score(F.lit(0.8), F.lit(0.5), F.lit(2)).alias("a"), scoring.transfer_score(F.lit(2.0), F.lit(None).cast("double"), F.lit(0)).alias("b"), scoring.transfer_score(F.lit(1.5), F.lit(9.0), F.lit(7)).alias("c")).first()
    assert tuple(score) == (0.24, 0.0, 0.0)


def test_best_paths_against_all_paths(spark):
    from sparkloom.operators import graph

    r = random.Random(17)
    for n, m, top in ((14, 40, 10), (20, 28, 200)):
        edges = {(min(a, b), max(a, b)): round(r.random(), 2) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b}
        near = {}
        for (a, b), w in edges.items():
            near.setdefault(a, {})[b] = near.setdefault(b, {}).setdefault(a, w)
        starts, ends = set(range(0, n, 2)), set(range(0, n, 3))
        want = {}
        for s in starts:
            layer, seen = {s: [((s,), 0.0)]}, {s}
            for d in range(1, 5):
                nxt = {}
                for v, walks in layer.items():
                    for u, w in near.get(v, {}).items():
                        if u not in seen:
                            nxt.setdefault(u, []).extend((p + (u,), t + w) for p, t in walks)
                seen |= set(nxt)
                layer = nxt
                for t in ends & set(layer):
                    for p, total in layer[t]:
                        want[min(p, p[::-1])] = (d, round(total / d * 0.8 ** (d - 1), 6))
        frame = spark.createDataFrame([(*e, w) for e, w in edges.items()], "src long, dst long, weight double")
        node = lambda x: spark.createDataFrame([(i,) for i in sorted(x)], "node long")
        got = [(tuple(x.path), x.hops, x.score) for x in graph.shortest_paths(frame, node(starts), node(ends), top=top).collect()]
        best = sorted(((p, d, s) for p, (d, s) in want.items()), key=lambda x: (-x[2], x[0]))[:top]
        assert [x[2] for x in got] == [x[2] for x in best] and all(want[p] == (d, s) for p, d, s in got)
        cut = best[-1][2] if best else 0
        assert {x for x in got if x[2] > cut} == {x for x in best if x[2] > cut}


def test_best_paths_end_where_longer_ones_cannot_reach_them(spark, monkeypatch):
    """Direct edges fill the best; only what could still reach them is searched
    further, and what is found stays exact: a shorter path of little weight hides
    a longer one of much."""
    from sparkloom.operators import graph

    near = [(i, 100 + i, 0.79) for i in range(10)]
    heavy = [(20, 21, 0.99), (21, 120, 1.0), (30, 31, 0.99), (31, 32, 1.0), (32, 130, 1.0), (40, 41, 1.0), (41, 140, 1.0), (40, 140, 0.1)]
    light = [(50, 60 + i, 0.5) for i in range(8)] + [(60 + i, 160 + i, 0.5) for i in range(8)]
    frame = spark.createDataFrame(near + heavy + light, "src long, dst long, weight double")
    node = lambda x: spark.createDataFrame([(i,) for i in x], "node long")
    rows, write = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, name: (found := write(df, name), rows.append(found.count()) if name == "front" else None)[0])
    starts, ends = [*range(10), 20, 30, 40, 50], [*range(100, 110), 120, 130, 140, *range(160, 168)]
    got = [(tuple(x.path), x.hops, x.score) for x in graph.shortest_paths(frame, node(starts), node(ends)).collect()]
    assert got == [((20, 21, 120), 2, 0.796)] + [((i, 100 + i), 1, 0.79) for i in range(9)]
    assert rows == [14, 22, 2]  # from 20 and 30 only (from 40 the way is longer than the edge), and nowhere on from there
