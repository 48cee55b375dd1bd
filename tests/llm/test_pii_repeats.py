"""A clear mention reaches every later repeat, however many lie between."""

import numpy as np

from ledgerloom.llm import pii


def test_label_reaches_the_fortieth_repeat():
    units = pii.Units("4111 1111 1111 1111 then " + " then ".join(["4111.1111.1111.1111"] * 40))
    links = np.array([link for link in units.links if link[0] == pii.SAME])
    assert len(links) == len(units.spans) - 1
    field = pii.Field()
    field.link[pii.SAME] = 6 * np.eye(len(pii.LABELS))
    field.unit[33, 3] = 8
    p = field.marginals([[33]] + [[1]] * (len(units.spans) - 1), links)
    assert p[-1].argmax() == 3 and p[-1, 3] > 0.8
