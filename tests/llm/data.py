"""Fixtures with what can go wrong: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

#: Names that operators use for columns of their own.
CLASHES = (
    "row key size target taken before cell n value norm salt head place keep_id kept group_size id twin "
    "body at stop fp slot root piece start length offset sequence_id held_out score statistics code "
    "query words rows part nth data found"
).split()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SCHEMA = f"{DOCUMENTS}, {', '.join(f'{c} string' for c in CLASHES)}"


def _prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(n))


def documents(seed: int = 3) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) rows. Ids are distinct but for the null ones."""
    rng = random.Random(seed)
    shared = [_prose(rng, 40) for _ in range(4)]
    texts: list[str | None] = [None, "", " \t\n", "x", "...", "123 456", "a" * 5000, "ab " * 4000]
    texts += [_prose(rng, 9000), "A  b\nC", "a B\tc ", "a b c", None, ""]
    for _ in range(60):
        texts.append(f"{_prose(rng, rng.randint(1, 60))} {rng.choice(shared)} {_prose(rng, rng.randint(0, 9))}")
    texts += [texts[20]] * 12 + [texts[21] + " \n", texts[22].upper(), texts[23] + " z", texts[24][:-3]]
    rows = []
    for i, text in enumerate(texts):
        lang = (None, "one", "two")[i % 3]
        source = (None, "b", "a", "ä", "B")[i % 5] if i % 4 else "hot"
        rows.append((i * 7 % 97 + i // 97 * 97, text, lang, source, None if text is None else len(text)))
    return rows


def frame(spark, rows: list[tuple], schema: str = SCHEMA, parts: int = 3):
    """The rows as documents, with all clashing columns filled."""
    wide = len(schema.split(",")) - 5
    return spark.createDataFrame([(*r, *["y"] * wide) for r in rows], schema).repartition(parts)
