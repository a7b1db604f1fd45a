"""op9 against a plain computation of the same windows, alignments and slots."""

import random
import re
from collections import defaultdict

import pytest

from wattloom.llm import decontamination as d
from wattloom.llm.decontamination import contaminated


def tokens(text):
    """(kind, word) of the tokens with letters or digits; a capitalised word inside a sentence is a name."""
    out, before = [], None
    for chunk in (text or "").split():
        core = re.sub(r"^[\W_]+|[\W_]+$", "", chunk)
        low = core.lower()
        if not core:
            kind = None
        elif any(c.isdigit() for c in core):
            kind = "number"
        elif low in d.UNITS:
            kind = "unit"
        elif before is not None and before[-1] not in ".!?:;" and core[0].isupper() and (core[1:].islower() or len(core) == 1):
            kind = "name"
        else:
            kind = "word"
        if kind:
            out.append((kind, low))
        before = chunk
    return out


def windows(toks, size, plain):
    for at in range(len(toks) - size + 1):
        own = toks[at : at + size]
        if plain:
            yield at, tuple(w for _, w in own), ()
        elif sum(k == "word" for k, _ in own) >= (size + 1) // 2:
            yield at, tuple(w if k == "word" else f"<{k}>" for k, w in own), tuple(f"{k}:{w}" for k, w in own if k != "word")


def brute(docs, items):
    out = set()
    for item, text in items:
        toks = tokens(text)
        size = min(len(toks), d.WINDOW)
        if not size:
            continue
        for doc, body in docs:
            own, verdict, clash = tokens(body), {}, False
            for plain in (False, True):
                total = {at for at, *_ in windows(toks, size, plain)}
                lines = defaultdict(list)
                for i, key, a in windows(toks, size, plain):
                    for j, other, b in windows(own, size, plain):
                        if key == other:
                            lines[j - i].append((i, set(zip(a, b, strict=True))))
                best = 0
                for hits in lines.values():
                    pairs = set().union(*(p for _, p in hits))
                    if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                        best = max(best, len({i for i, _ in hits}))
                    else:
                        clash = True
                if best and (best >= d.MIN_SHARE * len(total) or best >= d.MIN_RUN):
                    verdict[plain] = (best, len(total))
            if False in verdict:
                out.add((doc, item, *verdict[False]))
            elif True in verdict and (not clash or verdict[True][0] == verdict[True][1]):
                out.add((doc, item, *verdict[True]))
    return out


@pytest.mark.parametrize("small", [0, 50_000])
def test_against_plain_search(spark, monkeypatch, small):
    monkeypatch.setattr(d, "SMALL_WINDOWS", small)
    monkeypatch.setattr(d, "SMALL_BENCHMARK", 0 if not small else 2_000_000)
    rnd = random.Random(8)
    pool = "the of a to and in it go run fox tree lake stone bird 3 12 45 7.5 kg km hours Anna Boris Carl Dora".split()
    words = lambda n: [rnd.choice(pool) for _ in range(n)]
    items = [(k, words(rnd.choice([2, 5, 8, 9, 14, 25]))) for k in range(14)]
    docs = []
    for k in range(70):
        own = list(rnd.choice(items)[1])
        swap = {"Anna": "Olga", "3": "81", "kg": "lb", "12": rnd.choice(["12", "3"])}
        own = [swap.get(w, w) if k % 3 == 1 else w for w in own]
        for _ in range(rnd.choice([0, 0, 1, 3])):
            own[rnd.randrange(len(own))] = rnd.choice(pool)
        text = " ".join(words(rnd.randint(0, 12)) + own[: rnd.choice([len(own), len(own), 9])] + words(rnd.randint(0, 12)))
        docs.append((k, text.upper() if k % 7 == 0 else text))
    items = [(k, " ".join(w)) for k, w in items] + [(90, None), (91, "..."), (92, "")]
    docs += [(90, None), (91, ""), (92, "word " * 30_000 + items[5][1])]
    got = contaminated(spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, windows int"), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, plain int"))
    assert {tuple(r) for r in got.collect()} == brute(docs, items)


def test_repeated_rows_count_once(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, text), (7, text), (None, text)], "item_id long, text string")
    assert [tuple(r) for r in contaminated(docs, items).collect()] == [(1, 7, 3, 3)]
