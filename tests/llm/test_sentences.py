import random

import numpy as np
import pytest

from quillgraph.llm import sentences as S


def units(text):
    return [text[a:b] for a, b in S.sentence_spans(text)]


def test_quotation_closed_on_the_next_line():
    a = "Levée différée a déclaré : « La longue enquête fut critiquée hier.\n» La halle rurale et la digue furent différées par le conseil de la\nville, etc., en aval du pont."
    assert units(a) == ["Levée différée a déclaré : « La longue enquête fut critiquée hier.\n»", "La halle rurale et la digue furent différées par le conseil de la\nville, etc., en aval du pont."]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("قال سامي: «فُحص السد.» سأل نظام الطرق.", ["قال سامي: «فُحص السد.»", "سأل نظام الطرق."]),
        ("«هل بيع الجسر؟» سأل نظام الطرق دون إشعار! بيع السوق.", ["«هل بيع الجسر؟» سأل نظام الطرق دون إشعار!", "بيع السوق."]),
        ("بيع السوق. «هل بيع الجسر؟» سأل نظام الطرق.", ["بيع السوق.", "«هل بيع الجسر؟» سأل نظام الطرق."]),
    ],
)
def test_speakers_in_scripts_without_case(text, want):
    """A quotation that stands first takes the clause after it; one that its speaker led in ends with itself."""
    assert units(text) == want


@pytest.mark.parametrize("seed", range(5))
def test_blocks_compose(seed):
    """Any sequence of events gives the same units whatever the length of the blocks."""
    r = random.Random(seed)
    kinds = [r.randrange(S.N_EVENTS) for _ in range(500)]
    whole = S.cuts(kinds, 10**6)
    assert all(S.cuts(kinds, b) == whole for b in (1, 2, 7, 64, 499))
    assert S._function(np.array(kinds)).tolist() == [S._run(kinds, s)[1] for s in range(S.N_STATES)]
