import pytest

WORDS = ("the of and house river stone garden light winter summer paper window bridge mountain letter music "
         "market engine forest silver copper autumn harbor signal ladder basket candle mirror").split()


def text(seed: int, n: int) -> str:
    """n words by a fixed rule, in sentences."""
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 7 % len(WORDS)] + WORDS[x // 977 % len(WORDS)] + (". " if i % 9 == 8 else " "))
    return "".join(out).strip()


def rows() -> list[tuple]:
    """(doc_id, text, lang, source): copies, near copies, a shared passage, null, empty, short and long texts."""
    base, passage = text(1, 200), text(2, 60)
    words = base.split(" ")
    out = [(1, base, "en", "a"), (2, base, "en", "a"), (5, " ".join([*words[:100], "changed", *words[101:]]), "en", "b"),
           (9, text(3, 80) + " " + passage + " " + text(4, 80), "en", "b"), (10, passage + " " + text(5, 90), "en", None),
           (11, None, None, "c"), (12, "", "en", "c"), (13, " \n\t ", "en", "c"), (14, "One two", "en", "c"), (15, "one TWO", "en", "c"),
           (16, "é" * 60 + " ünï " + text(6, 3), "fr", "c"), (17, "x" * 30_000, "en", "c"), (18, text(7, 4000), "en", "a")]
    out += [(100 + i, text(50 + i, 60), "en" if i % 2 else "de", "a") for i in range(20)]
    return [*out, out[3]]  # one repeated row


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), i) for i, r in enumerate(rows())],
                                 "doc_id long, text string, lang string, source string, n_chars long, rep long").repartition(3)


@pytest.fixture(scope="session")
def texts():
    return {r[0]: r[1] or "" for r in rows()}


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
