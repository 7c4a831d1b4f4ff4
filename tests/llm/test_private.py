"""Personal data, against a detection written in plain Python."""

import random
from collections import defaultdict

import regex
from tessera.llm import pii

NAMED = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in pii.PATTERNS.items()))
INNER = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in pii.PATTERNS.items() if k != "card"))


def _card(digits):
    return 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _run(text):
    """(start, end) of the cards in a run of digits."""
    groups = [m.span() for m in regex.finditer(r"\d+", text)]
    for printed in (True, False):
        found, i = [], 0
        while i < len(groups):
            ends = [j for j in range(i, len(groups)) if _card("".join(text[a:b] for a, b in groups[i : j + 1]))]
            if printed:
                ends = [j for j in ends if i == j or ",".join(str(b - a) for a, b in groups[i : j + 1]) in pii.CARD_GROUPS]
            if ends:
                found.append((groups[i][0], groups[ends[-1]][1]))
                i = ends[-1]
            i += 1
        if found:
            return found
    return []


def _entities(text):
    """(start, end, kind) in order."""
    out = []
    for m in NAMED.finditer(text):
        if m.lastgroup != "card" or _card(regex.sub(r"\D", "", m.group())):
            out.append((*m.span(), m.lastgroup))
            continue
        at = 0
        for a, b in [*_run(m.group()), (len(m.group()), None)]:
            out += [(m.start() + at + x.start(), m.start() + at + x.end(), x.lastgroup) for x in INNER.finditer(m.group()[at:a])]
            if b:
                out.append((m.start() + a, m.start() + b, "card"))
                at = b
    last = {text[a:b].split(" ")[-1] for a, b, k in out if k == "name"}
    if last:
        gaps, at = [], 0
        for a, b, _ in sorted(out):
            gaps.append((at, a))
            at = b
        word = regex.compile(r"(?<!\p{L}|\p{L}-)(?:" + "|".join(sorted(last)) + r")(?!\p{L}|-\p{L})")
        for a, b in [*gaps, (at, len(text))]:
            out += [(a + m.start(), a + m.end(), "bare") for m in word.finditer(text[a:b])]
    return sorted(out)


def _check(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same, back, n = {}, defaultdict(set), 0
    for r in pii.replace_entities(rows, "a key").collect():
        text = texts[r.doc_id]
        found = _entities(text or "")
        assert r.n_entities == len(found) and r.entity_kinds == sorted({"name" if k == "bare" else k for *_, k in found}), (text, r.text)
        pattern, at = "", 0
        for a, b, k in found:
            same_length = k in ("card", "secret", "ssn", "iban", "phone")
            pattern += regex.escape(text[at:a]) + (f"(.{{{b - a}}})" if same_length else "(.+?)")
            at = b
        m = regex.fullmatch(pattern + regex.escape((text or "")[at:]), r.text or "", regex.DOTALL)
        assert m and (r.text is None) == (text is None), (text, r.text)
        for (a, b, k), new in zip(found, m.groups()):
            old = text[a:b]
            assert new != old and same.setdefault((k, old), new) == new
            if k in ("card", "secret", "ip", "ssn", "iban"):
                back[k, new.lower() if k != "secret" else new].add(regex.sub("[ -]", "", old) if k != "ip" else old)
            if k == "card":
                assert _card(regex.sub(r"\D", "", new)) and len(new) == len(old)
            if k == "iban":
                digits = regex.sub(" ", "", new)
                assert int("".join(str(int(c, 36)) for c in digits[4:] + digits[:4])) % 97 == 1 and new[:2] == old[:2]
            n += 1
    assert all(len(v) == 1 for v in back.values())
    return n


def test_table_and_probes(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    probes = [
        "2024-01-15 555-123-4567", "zip 12345 555-123-4567", "item 12 4111 1111 1111 1111", "1234 4111 1111 1111 1111", "4111 1111 1111 1111 2024-01-02", "card-4111111111111111-", "5555555555554444 4111 1111 1111 1111",
        "ab12" * 40, "sk-" + "a1B2" * 40, "0f" * 5000, "DE89 3704 0044 0532 0130 00, GB82WEST12345698765432", "ip 8.8.8.8", None, "", "Mr Brown met us. Brown said Brown's; Brown-Smith, Browning.", "Mr O'Neil. O'Neil's", "1 " * 300,
    ]
    assert _check(spark, texts + probes) > 30


def test_runs_of_digits(spark):
    rng = random.Random(6)
    cards = ["4111 1111 1111 1111", "378282246310005", "3782 822463 10005", "5555-5555-5555-4444", "6011111111111117"]
    other = ["2024-01-15", "555-123-4567", "12345", "12", "078-05-1120", "1234 5678", "9" * 25]
    texts = [rng.choice(" -").join(rng.choice(cards if rng.random() < 0.4 else other) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    assert _check(spark, texts) > 300


def test_one_person_has_one_name(spark):
    texts = ["Ms Anna Green, Dr Anna Green, Mr Anna Green", "Mr. Anna Green", "Prof Anna Green and Anna", "Mr Ivo Green; Mrs Ivo Black", "Г-н Иванов пришёл. Иванов ушёл"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace_entities(rows, "a key").collect()}
    found = {regex.sub(r"^\S+ ", "", x) for k in (0, 1) for x in got[k].split(", ")} | {regex.match(r"Prof (\S+ \S+) and Anna$", got[2])[1]}
    assert len(found) == 1
    one, two = got[3].split("; ")
    assert one.split()[2] == found.pop().split()[1] and one.split()[1][:-3] == two.split()[1][:-2] and one.split()[1].endswith("nor") and two.split()[1].endswith("na")
    assert regex.fullmatch(r"Г-н (\w+нов) пришёл\. \1 ушёл", got[4])
