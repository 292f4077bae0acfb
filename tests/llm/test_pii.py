import random
import re

from corvine.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {0: True, 1: all(int(p) <= 255 for p in m[0].split(".") if kind == 1), 2: 14 <= len(digits) <= 19 and pii.luhn(digits), 3: 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("a1.2@+-( )9%0 é") for _ in range(rng.randint(0, 60)))
        assert pii.base(text) == brute(text), text
    known = "a@b.c x 1.2.3.4 y 4111 1111 1111 1111 z +1 (212) 555-0100 x 300.1.1.1 y +12 z 1.2.3.4.5"
    assert pii.base(known) == brute(known) and [k for _, k, _ in pii.base(known)] == [0, 1, 2, 3, 1]


def test_base_is_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+" * 100_000, "+1" + "(" * 200_000, "@" * 100_000):
        pii.find([text], pii.Field())


def test_the_field_learns_its_table_and_viterbi_is_exact():
    import itertools

    import numpy as np

    m = pii.train()
    wrong = sum(sorted(pii.extra([t], m)[0]) != sorted((s, pii.KINDS.index(k), e) for s, e, k in spans) for t, spans in pii.read_labelled(pii.LABELLED))
    assert wrong == 0
    assert pii.written(pii.find(["please call (212) 555-0177 now"], m)[0][1]) == "phone:12:26"
    rng = np.random.default_rng(0)
    score, move = rng.normal(size=(5, 4, 3)), rng.normal(size=(3, 3))
    for s, path in zip(score, pii.viterbi(score, move), strict=True):
        value = lambda p: move[0, p[0]] + sum(s[i, x] for i, x in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False)) + move[p[-1], 0]  # noqa: E731,B023
        assert tuple(path) == max(itertools.product(range(3), repeat=4), key=value)


def test_long_tokens_are_judged_part_by_part():
    m = pii.train()
    assert pii.find(["sales@localhost"], m)[0][1] == [(0, 0, 15)]
    for head, tail in (('{"k":"' + "v" * 240 + '","mail":"', '"}'), ("a,b;" * 12, ",c"), ("\u6f22" * 300, "\u5b57")):
        assert pii.find([head + "sales@localhost" + tail], m)[0][1] == [(len(head), 0, len(head) + 15)]


def test_odd_and_empty_tables(spark, odd, none):
    got = pii.report(odd).collect()
    assert len(got) == odd.count() and all(r.n_email + r.n_ip + r.n_card + r.n_phone == 0 for r in got)
    assert pii.report(none).count() == 0 and pii.redact(none).columns == none.columns
    rows = spark.createDataFrame([(1, "mail ann@x.org or 10.0.0.1"), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.redact(rows).orderBy("doc_id").collect()] == ["mail [EMAIL] or [IP]", None]
