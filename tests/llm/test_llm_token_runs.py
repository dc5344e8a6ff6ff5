"""White space that follows white space, as the cutting of texts sees it."""

import random
import re

from decoylens.llm import tokenfile


def test_runs_of_white_space():
    spaces = [chr(i) for i in range(0x110000) if re.match(r"\s", chr(i))]
    assert sorted(spaces) == sorted(tokenfile.OTHER_SPACE + " \n")
    draw = random.Random(5)
    for _ in range(20_000):
        text = "".join(draw.choices([*"ab é", "\n", *spaces], k=draw.randint(0, 6)))
        assert tokenfile.has_run(text) == bool(re.search(r"\s\s", text))


def test_plain_texts_need_no_pattern(monkeypatch):
    monkeypatch.setattr(tokenfile, "_RUN", None)
    assert tokenfile.cut(["one two\nthree é", None]).to_pylist()[0] == ["one", " two", "\n", "three", " é"]
