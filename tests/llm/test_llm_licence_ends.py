"""Licence expressions that end within a bracket."""

import itertools

import pytest

from decoylens.llm import licences


@pytest.mark.parametrize(
    "expression, order",
    [
        ("mit and (", ["mit"]),
        ("mit or ()", ["mit"]),
        ("mit and ((", ["mit"]),
        ("a or b and (", ["a", "b", "or"]),
        ("a or (b and (", ["a", "b", "or"]),
        ("a and (b or", ["a", "b", "and"]),
        ("(", []),
    ],
)
def test_an_open_bracket_behind_an_operator(expression, order):
    assert licences.postfix(iter(licences.tokens(expression, 0))) == order
    for end in ("", "\n", '"', " é"):
        found = licences.scan_text(f"License: {expression}{end}")
        assert ("mit" in found["labels"]) == ("mit" in expression)


def test_any_expression_is_evaluated():
    for n in range(1, 7):
        for parts in itertools.product(["mit", "and", "or", "with", "(", ")"], repeat=n):
            licences.scan_text(f"License: {' '.join(parts)}") if n < 4 else licences.evaluate(licences.postfix(iter(parts)))
