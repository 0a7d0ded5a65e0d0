"""Personal data: candidates reach to their ends, and the quick look at a text misses none."""

import pytest

from supplylens.llm import pii


def found(text, kind):
    return [text[s:e] for s, k, e in pii.candidates(text, pii.base_spans(text)) if pii.KINDS[k] == kind]


@pytest.mark.parametrize("n", [4, 128, 129, 300, 100_000])
def test_secrets_run_to_their_end(n):
    secret = "token=" + ("aB3_" * n)[:n]
    assert found(f"login {secret}, then", "secret") == [secret]


def test_secrets_leave_base_spans_alone():
    value = "aB3_" * 50
    text = f"token={value}/a@b.com/{value}/1.2.3.4/{value} end"
    assert [text[s:e] for s, _, e in pii.base_spans(text)] == ["a@b.com", "1.2.3.4"]
    assert found(text, "secret") == [f"token={value}/", f"/{value}/", f"/{value}"]
    assert found("token=a@b.com", "secret") == [] and found("token=abcd/a@b.com.", "secret") == ["token=abcd/"]


@pytest.mark.parametrize("space", ["", " ", "\t", "\n", "\r", "\u00a0", "\u2003", "\u3000"])
@pytest.mark.parametrize("close", "])")
def test_spelled_addresses_with_any_space(space, close):
    spelled = f"bob [at{space}{close} example [dot] org"
    assert found(f"write {spelled} now", "email_spelled") == [spelled]


@pytest.mark.parametrize("n", [1, 64, 65, 5000])
def test_candidates_have_no_longest_part(n):
    local, part = "a" * n, "b" * n
    spelled = f"{local} [at] {part} [dot] " + " [dot] ".join([part] * 7)
    assert found(f"write {spelled}, now", "email_spelled") == [spelled]
    for kind, text in (("name", f"Mrs. A{local} B{part}"), ("street", f"{'1' * min(n, 300)} A{local} Street")):
        assert found(f"so {text}. end", kind) == [text]


def test_hostile_texts_take_linear_time():
    for text in ("a" * 300_000 + "(at)", "1" * 200_000 + " Street", "Mr A" + "a" * 200_000, "a-" * 100_000 + "[at]", "x [at] " + "b." * 100_000, "token=" * 50_000):
        pii.candidates(text, pii.base_spans(text))


def test_gazetteers_can_be_given():
    at = lambda text, known: pii.votes(text, 3, pii.KIND_AT["name"], len(text), known)[2]
    assert at("to Mr Zaphod", pii.Gazetteers()) == 0 and at("to Mr Zaphod", pii.Gazetteers(names=frozenset(["zaphod"]))) == 1
    mail = "bob [at] mail [dot] gmail [dot] com"
    assert pii.votes(mail, 0, pii.KIND_AT["email_spelled"], len(mail))[2] == 1


def test_overlapping_candidates_are_settled_by_score():
    text = "5 Maple Dr Martin Smith"
    kinds = {pii.KINDS[k]: (text[s:e], (s, k, e)) for s, k, e in pii.candidates(text, [])}
    assert kinds["name"][0] == "Dr Martin Smith" and any("5 Maple Dr" == t for t, _ in kinds.values())
    street = next(c for t, c in kinds.values() if t == "5 Maple Dr")
    name = kinds["name"][1]
    assert pii.settle([(1.0, street), (2.0, name)]) == [name] and pii.settle([(3.0, street), (2.0, name)]) == [street] and pii.settle([(2.0, name)]) == [name]
    assert pii.settle([(1.0, (0, 0, 3)), (2.0, (2, 1, 6)), (1.5, (5, 0, 9)), (1.0, (9, 0, 12))]) == [(2, 1, 6), (9, 0, 12)]


def test_no_candidate_touches_any_of_many_base_spans():
    base = [(i * 3, 0, i * 3 + 2) for i in range(12)] + [(40, 1, 70)]
    text = "x" * 36 + "    Dr Martin Smith" + " " * 40 + "Mrs Anna Jones"
    assert [text[s:e] for s, _, e in pii.candidates(text, base)] == ["Mrs Anna Jones"]
