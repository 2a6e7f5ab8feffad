"""A small corpus with all that may go wrong, and an empty one."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, repeats string, score double, _mix int"


def corpus(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = {lang: ["".join(rng.choice(s) for _ in range(rng.randint(2, 7))) for _ in range(120)] for lang, s in (("en", "etaoinshr"), ("de", "enisräüch"), ("fr", "éèçaouvqx"))}
    draw = lambda lang, n: [rng.choice(words[lang]) for _ in range(n)]
    passage, base = draw("en", 40), draw("en", 120)
    texts: list[tuple[str | None, str | None]] = [(None, "en"), ("", "en"), (" \n\t ", "de"), ("one", None), ("two words", "en"), ("123 456 !!", "en"), ("x " * 40, "en"), ("ÄÖ", "de")]
    for i in range(70):
        lang = ("en", "de", "fr")[i % 3]
        own = draw(lang, rng.randint(8, 90))
        if i % 7 == 0:
            own[len(own) // 2 : len(own) // 2] = passage
        if i % 5 == 0:
            own[3:3] = f"Mail bo{i % 3}@mail.example.com or +1 (555) 010-{1000 + i} at 10.0.{i}.7 card 4111 1111 1111 1111".split()
        text = " ".join(own)
        texts.append((text.replace(" ", "\n", 3) if i % 4 == 0 else text, lang if i % 11 else None))
    for i in range(25):  # near copies, and copies of the copies
        own = list(base)
        for _ in range(i % 6):
            own[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
        texts.append((" ".join(own), "en"))
    texts += [texts[20]] * 6 + [("\n".join([" ".join(draw("en", 6))] * 5), "en"), ("Junk### " * 3 + " ".join(w + "$$$" for w in draw("en", 30)), "en"), (" ".join(draw("en", 4000)), "en")]
    rows = [(i, t, lang, rng.choice(["a", "b", "c", "é", None]) if i % 3 else "a", len(t or ""), "k", "r", 0.5, 1) for i, (t, lang) in enumerate(texts)]
    rng.shuffle(rows)
    # an id twice, a row twice, and no id
    return [*rows, (5, "another text of that id", "en", "a", 1, None, None, None, None), rows[3], (None, "no id here", None, None, None, None, None, None, None)]


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    known = [r[1] for r in rows if r[1] and len(r[1].split()) >= 40]
    items = [(i, " ".join(t.split()[5 : 5 + 12 * (i + 1)])) for i, t in enumerate(known[:3])] + [(7, None), (8, ""), (9, "nothing of this kind is anywhere in here at all")]
    spark.createDataFrame(items if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(r[0], int("###" not in (r[1] or "")), 0) for r in rows if r[0] is not None and r[0] % 2 == 0]
    spark.createDataFrame(labels * (2 if rows else 1), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def small(spark, rows, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("small"), rows)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [])
