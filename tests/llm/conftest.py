import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, text_crc32 string"


def base_texts() -> list[tuple[int | None, str | None]]:
    """Ids and texts: copies, near copies, shared passages, odd and long texts."""
    r = random.Random(7)
    vocab = ["".join(r.choices("abcdefghijklmnop", k=r.randint(1, 8))) for _ in range(400)] + ["Ünï", "çé", "日本語", "ИМЯ", "İx"]
    say = lambda n: " ".join(r.choices(vocab, k=n))
    out: list[tuple[int | None, str | None]] = []
    whole = say(60)
    out += [(i, whole) for i in range(10, 22)]  # exact copies
    near = say(80).split()
    for i in range(30, 42):  # near copies
        w = list(near)
        w[r.randrange(80)] = "changed"
        out.append((i, " ".join(w)))
    chain = say(100).split()
    for i in range(4):  # links by steps
        out.append((50 + i, " ".join(chain[3 * i :] + say(3 * i).split())))
    passage = say(70)
    out += [(60 + i, f"{say(20)}\n{passage} {say(15)}") for i in range(6)]
    out += [(70, None), (71, ""), (72, " \t\n"), (73, "one"), (74, "One"), (75, "a b c d"), (76, "A  b\tc d"), (77, "x" * 350), (78, "ab" * 300)]
    out += [(79, "Licensed under the MIT License, and under the mit-license. Apache License, Version 2.0"), (80, "cc by nc cc-BY-nc under_the_mit_license under the mit"), (81, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files")]
    out += [(82, f"{say(30)}<|endoftext|>{say(5)} <|endoftext|><|endoftext|>"), (83, say(9000)), (84, "é" * 120 + say(20) + "é" * 120)]
    out += [(90 + i, say(r.randint(5, 120))) for i in range(20)]
    out += [(95, out[-15][1]), (None, say(30)), (None, whole), (-3, whole)]
    return out


@pytest.fixture(scope="session")
def rows():
    found = base_texts()
    seen: dict = {}
    for i, t in found:  # one text for each id
        seen.setdefault(i if i is not None else object(), (i, t))
    return list(seen.values())


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", None, 1, "x") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
