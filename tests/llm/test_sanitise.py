import math
import random
import re
from collections import Counter

from llm_cases import SMALL, docs  # noqa: F401

from orderlens.llm import sanitise

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def by_hand(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(0, *m.span()) for m in EMAIL.finditer(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and sanitise.luhn(digits(m))]
    return found + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def test_fixed_patterns(spark):
    fuzz = random.Random(1)
    made = ["".join(fuzz.choice("a@..-b1234 +()%é0") for _ in range(fuzz.randint(0, 40))) for _ in range(5000)]
    made += ["4111 1111-1111 1111", "9" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1" * 50_000, "0000000000000000000000255.1.1.1"]
    made += [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for text in made:
        if len(text) < 250_000:
            assert [tuple(s) for s in sanitise.entities(text)] == by_hand(text), text[:100]
        else:
            sanitise.entities(text)  # long runs end


def corpus():
    fuzz = random.Random(8)
    plain = "the of and house tree river walk green light stone".split()
    rows = []
    for i in range(300):
        words = [fuzz.choice(plain) for _ in range(40)]
        if i % 10 == 0:
            words[20:20] = ["Kontakt", f"user{i}@mail.example.org"]
        rows.append((i, " ".join(words)))
    return rows


def test_disclosing_terms(docs):  # noqa: F811
    rows = corpus()
    got = {(r["kind"], r["term"]): r["ratio"] for r in sanitise.disclosing_terms(docs(*rows)).collect()}
    # By hand: word positions within five words of an address, outside it.
    all_words, near, total = Counter(), Counter(), 0
    for _, text in rows:
        spans = [s for s in sanitise.entities(text)]
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", text)]
        all_words.update(w for *_, w in words)
        total += len(words)
        for s in spans:
            before = [w for a, b, w in words if b <= s.start][-5:]
            after = [w for a, b, w in words if a >= s.end][:5]
            near.update(before + after)
    n = sum(near.values())
    ratio = {w: math.log2(total * near[w] / (all_words[w] * n)) / math.log2(total / n) for w in near}
    want = {w: r for w, r in ratio.items() if r >= sanitise.GENERALISE}
    assert set(want) == {"kontakt"} and {k: round(v, 9) for (k, v) in ((t, r) for (_, t), r in got.items())} == {"kontakt": round(want["kontakt"], 9)}


def test_spans_and_text(docs):  # noqa: F811
    rows = corpus() + [(400, None), (401, ""), (None, "Kontakt alone"), (402, "x@y.zz"), (402, "x@y.zz")]
    found = sanitise.found(docs(*rows), ["doc_id", "n", "label"]).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] < 4]
        assert base == by_hand(texts[r["doc_id"]] or "")
        terms = [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == 4]
        assert terms == (["Kontakt"] if r["doc_id"] is not None and r["doc_id"] < 300 and base else [])
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitised(docs(*rows)).collect()}
    assert "Kontakt" not in clean[10] and "<email>" in clean[10] and "@" not in clean[10]
    assert clean[None] == "Kontakt alone" and clean[400] is None and clean[402] == "<email>"
    assert sanitise.found(docs(*rows).where("false"), ["doc_id"]).count() == 0
