import random
import zlib

import pytest

WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def corpus() -> list[tuple]:
    """Texts with copies, near copies, shared passages, junk, nulls, empty and long texts and repeated rows."""
    rows = [(i, prose(20 + i % 60, i), "a" if i % 3 else "hot") for i in range(60)]
    base = prose(150, 999)
    rows += [(100 + i, base, "hot") for i in range(6)]
    for i in range(12):
        w = base.split()
        for k in range(1 + i % 4):
            w[(i * 17 + k * 31) % len(w)] = f"edit{i}"
        rows.append((200 + i, " ".join(w), "hot"))
    passage = prose(120, 4242)
    rows += [(300 + i, prose(30, 70 + i) + " " + passage + " " + prose(30, 80 + i), None) for i in range(4)]
    rows += [(400, None, "a"), (401, "", "a"), (402, " \t\n ", None), (403, "One", "a"), (404, "one", "a"), (405, "Émile naïve — 東京 ﬁń", "a"), (406, "x" * 3000, "a"), (407, "ab " * 2000, "a")]
    rows += [(408, prose(9000, 5), "a"), (None, "no id at all here", None), (None, None, None)]
    rows += [(409, "same row", "a")] * 3
    return rows


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """The corpus as Parquet in several files, with extra columns whose names operators use themselves."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    df = spark.createDataFrame([(*r, "x", 1, "k", 2.0) for r in corpus()], "doc_id long, text string, source string, row string, n int, key string, score double")
    df.repartition(3, "n", "text").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(path)
    return spark.read.parquet(path)


def held(doc_id, mod: int, value: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod == value
