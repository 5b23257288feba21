"""Personal data: plain spans against the patterns, recall of generated disguises, and time on long runs."""

import random
import re
import time

import pytest

from weftgraph.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, t):
    d = re.sub(r"[^0-9]", "", t)
    if kind == "ip":
        return all(int(x) <= 255 for x in t.split("."))
    if kind == "card":
        s = sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(map(int, reversed(d))))
        return 12 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


@pytest.mark.parametrize("letters", ["12.3 ", "0.12 -", "+1 ()-2.", "4 -40418", "a.@b-1 +"])
def test_plain_spans_equal_the_patterns(letters):
    rng = random.Random(letters)
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        want = sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(PATTERNS[kind], t) if fits(kind, m[0]))
        assert pii.find_spans(t) == want, t


def card(rng):
    d = [rng.randint(0, 9) for _ in range(15)]
    s = sum((2 * x - 9 * (x > 4)) if i % 2 == 0 else x for i, x in enumerate(reversed(d)))
    return "".join(map(str, [*d, -s % 10]))


WORDS = {"en": "zero one two three four five six seven eight nine", "de": "null eins zwei drei vier fünf sechs sieben acht neun", "es": "cero uno dos tres cuatro cinco seis siete ocho nueve", "fr": "zéro un deux trois quatre cinq six sept huit neuf"}


def disguised(rng):
    kind = rng.choice(pii.KINDS)
    name = lambda n: "".join(rng.choice("abcdefghijklmnoprstuvwxyz") for _ in range(rng.randint(2, n)))
    if kind == "email":
        local, parts = name(8) + rng.choice(["", "." + name(6), "_7"]), [name(8), rng.choice(["com", "org", "net"])]
        way = rng.randint(0, 3)
        if way == 0:
            at, dot = rng.choice([" [at] ", "(at)", " {AT} ", " <at> ", "[@]"]), rng.choice([" [dot] ", "(dot)", " dot ", "[.]", "."])
            return kind, local + at + dot.join(parts)
        if way == 1:
            return kind, local.replace(".", " dot ") + " at " + " dot ".join(parts)
        plain = f"{local}@{'.'.join(parts)}"
        if way == 2:
            swap = {v: k for k, v in pii.LOOKALIKES.items() if ord(k) < 0x500 and v.isalpha()}
            at = [i for i, c in enumerate(plain) if c in swap]
            return kind, "".join(swap[c] if i in at[:3] else c for i, c in enumerate(plain)) if at else plain.replace("@", "\uff20")
        return kind, plain[:2] + "\u200b" + plain[2:]
    digits = {"ip": ".".join(str(rng.randint(1, 255)) for _ in range(4)), "card": card(rng), "phone": "+" + "".join(str(rng.randint(0, 9)) for _ in range(rng.randint(10, 13)))}[kind]
    if kind == "ip":
        return kind, digits.replace(".", rng.choice(["[.]", " [dot] ", " dot ", "(dot)", "\u3002"]))
    way = rng.randint(0, 2)
    if way == 0:
        return kind, "".join(chr(0xFF10 + int(c)) if c.isdigit() else c for c in digits)
    if way == 1:
        return kind, "\u200b".join(digits)
    words = WORDS[rng.choice(["en", "de", "es"])].split()
    return kind, rng.choice([" ", "-", ", "]).join(words[int(c)] if c.isdigit() else "plus" for c in digits)


def test_recall_of_disguises_and_of_clean_text():
    rng = random.Random(11)
    hit = total = 0
    for _ in range(800):
        kind, text = disguised(rng)
        before, after = rng.choice(["Write: ", "é call ", "It is "]), rng.choice([" now.", "; thanks", " ok"])
        whole = before + text + after
        found = [(whole[a:b], pii.KINDS[k]) for a, k, b in pii.find_spans(whole) + pii.hidden_spans(whole, pii.find_spans(whole))]
        total += 1
        hit += (text, kind) in found
    assert hit >= 0.9 * total, hit / total
    for _ in range(300):
        clean = " ".join(rng.choice(["the", "cat", "at", "home", "dot", "one", "two,", "7", "and", "(at", "last)", "seven", "eleven.", "12"]) for _ in range(30))
        low = re.sub(r"dot|one|two|seven|7|12", "x", clean)
        assert not pii.find_spans(low) and not pii.hidden_spans(low, []), low


@pytest.mark.parametrize("text", ["a" * 300_000, "a." * 150_000, "1" * 300_000, "1 " * 150_000, "one " * 70_000, "a at " * 60_000, "a dot " * 50_000, " " * 300_000, "+1(" * 100_000, "[ " * 150_000, "a@" * 150_000, "1.1.1," * 50_000, "plus " * 60_000])
def test_time_is_linear(text):
    whole = "x [at] y [dot] org \u200b one two three four " + text + " z"
    began = time.time()
    pii.hidden_spans(whole, pii.find_spans(whole))
    assert time.time() - began < 6


def test_rewriting_keeps_places():
    x = pii.Mapped("abcdef").rewrite([(1, 3, "XYZ"), (4, 5, "")])
    assert x.text == "aXYZdf" and x.starts.tolist() == [0, 1, 1, 1, 3, 5] and x.ends.tolist() == [1, 3, 3, 3, 4, 6]
    y = x.rewrite([(0, 2, "q"), (5, 6, "rs")])
    assert y.text == "qYZdrs" and y.starts.tolist() == [0, 1, 1, 3, 5, 5] and y.ends.tolist() == [3, 3, 3, 4, 6, 6]
