from __future__ import annotations

import random
import re

from headroom.llm import catalog, personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for kind, name in enumerate(personal_data.KINDS):
        for m in re.finditer(PATTERNS[name], text):
            digits = re.sub("[^0-9]", "", m[0])
            keep = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if name == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[name]
            if keep:
                out.append((kind, m.start(), m.end()))
    return out


def test_forms_are_those_of_the_patterns():
    rng = random.Random(5)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111111111111111", "4111-1111 1111 1111", "+1 (415) 555-0199",
              "+49 30 1234567", " ", "é", "0001.2.3.4", ".", "-", "+", "7", "a@b.c@d.e", "\n", "%_", "12 34"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))
        assert personal_data.forms(text) == plain(text), text


def test_long_runs_take_linear_time():
    for letter in ("a", "1", "+1 ", "1.", "@"):
        personal_data.forms(letter * 200_000 + "@")


def test_patterns_discover_what_no_form_knows(rows):
    known = [f"filler {w} words. please write to user{i}@mail.example.com soon" for i, w in enumerate("abcdefgh")]
    texts = [*known, "other text, please write to bob77-at-example today", "room 4711 is free", None, ""]
    found = personal_data.with_spans(rows(*texts), "doc_id").select("row.doc_id", "base", "spans").collect()
    by_id = {r.doc_id: r for r in found}
    assert [(s.kind, texts[8][s.begin : s.end]) for s in by_id[8].spans] == [(0, "bob77-at-example")]
    assert by_id[8].base == [] and by_id[9].spans == by_id[10].spans == by_id[11].spans == []
    assert all(by_id[i].spans == by_id[i].base and len(by_id[i].base) == 1 for i in range(8))
    clean = {r.doc_id: r.text for r in personal_data.redacted(rows(*texts)).collect()}
    assert clean[8] == "other text, please write to [EMAIL] today" and clean[9] == texts[9] and clean[10] is None


def test_mixed_contexts_are_not_trusted(rows):
    seeds = [f"some words of the user{i}@mail.example.com here" for i in range(6)]
    others = [f"some words of the number {i}00{i} of the x{i}y{i}z here" for i in range(6)]
    found = personal_data.with_spans(rows(*seeds, *others), "doc_id")
    assert found.where("size(spans) > size(base)").count() == 0


def test_repeated_rows_and_empty_table(rows):
    text = "mail a.b@c.de now"
    found = personal_data.with_spans(rows(text, text, text, ids=[1, 1, None]), "doc_id")
    assert [(s.kind, s.begin, s.end) for r in found.collect() for s in r.spans] == [(0, 5, 13)] * 3
    assert personal_data.with_spans(rows(ids=[]), "doc_id").count() == 0


def test_query_counts_each_kind(rows, spark, tmp_path):
    texts = ["x@y.zz a.b@c.de", "1.2.3.4", "4111111111111111", "call +49 30 1234567", "1.2.3.4 5.6.7.8 9.9.9.9 4111 1111 1111 1111 x@y.zz", "", None]
    rows(*texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in catalog.op8_pii_bootstrap(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        kinds = [kind for kind, _, _ in plain(text or "")]
        assert found[i] == tuple(kinds.count(k) for k in range(4)), text
