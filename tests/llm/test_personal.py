"""Personal data: base patterns against the plain regular expressions, disguises and their offsets."""

import hashlib
import random
import re

import pytest

from pagemill.llm.personal import KINDS, detect, find_personal, luhn, personal_data

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else False, 16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15]
            if ok[k]:
                out.append((k, m.start(), m.end()))
    return out


def test_base_like_the_plain_patterns():
    draw = random.Random(3)
    seen = 0
    for _ in range(20_000):
        text = "".join(draw.choice("ab@@..1234 -+()é%7") for _ in range(draw.randint(0, 60)))
        assert detect(text) == brute(text), text
        seen += len(detect(text))
    for text in ["4111111111111111", "4111 1111-1111 1111 x 4111111111111112", "a@b.c@d.e f@g", "1.2.3.4.5.6.7.8", "0000255.1.1.1", "256.1.1.1", "+1 (988) 555-2485.", "+" * 50]:
        assert detect(text) == brute(text), text
        seen += len(detect(text))
    assert seen > 1000


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("write bob [at] mail (dot) example dot com now", "email", None),
        ("write bob (at) mail.example.com now", "email", "bob (at) mail.example.com"),
        ("x jane at mail dot com y", "email", "jane at mail dot com"),
        ("ja​ne@mаil.com", "email", "ja​ne@mаil.com"),
        ("call plus one two one two five five five zero one nine nine ok", "phone", "plus one two one two five five five zero one nine nine"),
        ("card ４111 1111 1111 1111 end", "card", "４111 1111 1111 1111"),
        ("host 10 dot 0 dot 0 dot 1 up", "ip", "10 dot 0 dot 0 dot 1"),
        ("host 10[.]0[.]0[.]1 up", "ip", "10[.]0[.]0[.]1"),
    ],
)
def test_disguises(text, kind, part):
    base, spans = find_personal(text)
    more = [s for s in spans if s not in base]
    assert [KINDS[k] for k, _, _ in more] == [kind], spans
    if part:
        assert text[more[0][1] : more[0][2]] == part


@pytest.mark.parametrize("text", ["meet at noon, at six, one two many dots", "the one at hand dot", "one two three", "", None, "é à ñ ü the of", "we dot the i"])
def test_clean_texts_stay_clean(text):
    assert find_personal(text) == ([], [])


def test_long_texts_take_linear_time():
    for text in ["1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1 " * 100_000, "a@" * 100_000, "one two " * 30_000, "4 " * 200_000]:
        find_personal(text)


def test_table(spark):
    rows = [(1, "a@b.cd +1 555 123 4567", "x"), (1, "a@b.cd +1 555 123 4567", "x"), (2, None, "y"), (3, "", "z"), (4, "h \U0001f600 10.0.0.1", "w"), (None, "x", ""), ((1 << 62) + 1, "x", "")]
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    told = {r.doc_id: r.spans for r in got}
    assert len(got) == 7 and told == {1: "email:0:6,phone:7:22", 2: "", 3: "", 4: "ip:4:12", None: "", (1 << 62) + 1: ""}
    assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in got)
    assert personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("write jane at mail.com now", "email", "jane at mail.com"),
        ("we dot the i, write jane at mail.com now", "email", "jane at mail.com"),
        ("write jane at mail.example dot com now", "email", "jane at mail.example dot com"),
        ("card 4 one 1 one 1 one 1 one 1 one 1 one 1 one 1 one end", "card", "4 one 1 one 1 one 1 one 1 one 1 one 1 one 1 one"),
        ("call plus one two one two five five five zero one nine nine nineteen", "phone", "plus one two one two five five five zero one nine nine"),
    ],
)
def test_a_span_depends_on_itself_only(text, kind, part):
    for around in ("", " dot ", " (at) ", " one two "):
        told = [(KINDS[k], (text + " ." + around)[a:b]) for k, a, b in find_personal(text + " ." + around)[1]]
        assert (kind, part) in told, told


@pytest.mark.parametrize("text", ["it rose at 2.5 percent", "closed at 5.30 and at 17.45.10", "two dot the i and it rose at 2.5 percent"])
def test_numbers_after_at_are_no_addresses(text):
    assert find_personal(text) == ([], [])


def test_long_runs_take_linear_time():
    for text in ["4 " * 200_000 + "12345", "one 4 " * 50_000 + "4x", "a at " * 100_000, "a at 1" + ".1" * 100_000, "a at b.c " * 50_000]:
        find_personal(text)


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("write mаria@example.com now", "email", "mаria@example.com"),
        ("write jane@example.cоm now", "email", "jane@example.cоm"),
        ("call +44 20 7946 ０958 now", "phone", "+44 20 7946 ０958"),
    ],
)
def test_a_plain_rest_does_not_hide_the_whole(text, kind, part):
    base, spans = find_personal(text)
    assert len(base) == 1 and set(base) < set(spans)
    assert [(KINDS[k], text[a:b]) for k, a, b in spans if (k, a, b) not in base] == [(kind, part)]
