import random

import numpy as np
import pytest

from payerlens.llm import pii
from tests.llm.conftest import sentence

#: Spans that pass the checks, with digits far apart, long hosts, odd blanks and one-letter ends.
FORMS = [
    ("phone", "+4      9      3     0   1     2      3     4     5"),
    ("phone", "+49 (0)     30 . . . . .12 - - - - -34 . . . . .56"),
    ("phone", "1 (743) 555-3824"),
    ("card", "4 4 6 5 7 5 8 3 8 2 8 8 9 4 3 7"),
    ("ip", "1.2.3.4"),
    ("email", "jane at " + "verylonglabel-" * 6 + "x dot example dot org"),
    ("email", "jane.doe    (at)     host     (dot)     org"),
    ("email", "jane dot maria dot doe at host dot org"),
    ("email", "jane [at]\n\n\n\n host [dot]\n\n de"),
    ("email", "jane at host.c"),
    ("email", "jane at host.42"),
    ("email", "jane-at-host.org"),
    ("email", "jane@host" + " dot example" * 12 + " dot org"),
]


def every_window(text):
    return list(range(0, len(text), pii.STRIDE))


@pytest.mark.parametrize(("kind", "form"), FORMS)
def test_what_can_pass_is_looked_at(kind, form):
    assert pii.plausible(kind, form)
    for before in range(0, 200, 7):
        text = ("plain words " * 20)[:before] + " " + form + " and plain words after it" * 8
        a = text.index(form)
        b = a + len(form)
        touching = [s for s in every_window(text) if s < b and s + pii.WINDOW > a]
        assert set(touching) <= set(pii.window_starts(text))


def test_windows_left_out_change_nothing(monkeypatch):
    model, rng = pii.train(), np.random.default_rng(77)
    texts = [sentence(random.Random(i), 40) + " " + pii.labelled_text(rng, 200)[0] + sentence(random.Random(-i), 40) for i in range(60)]
    texts += [f"{sentence(random.Random(i), 30)} {form} {sentence(random.Random(i), 30)}" for i, (_, form) in enumerate(FORMS)]
    bases = [pii.base_spans(t) for t in texts]
    found = pii.added_spans(texts, bases, model)
    assert sum(len(pii.window_starts(t)) for t in texts) < sum(len(every_window(t)) for t in texts)
    monkeypatch.setattr(pii, "window_starts", every_window)
    assert pii.added_spans(texts, bases, model) == found
    assert sum(map(len, found)) > 50

