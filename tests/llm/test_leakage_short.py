"""Items shorter than a seed are found."""

import pytest

from tessera.llm import leakage as L


@pytest.mark.parametrize("item", ["zulek", "zulek morav", "zulek morav tarin"])
def test_short_items_are_found(item):
    items = L.Items.of([(7, item), (8, "one two three four five six")])
    text = f"before it came {item} and then nothing more"
    assert [x[0] for x in items.leaks(text, 0.6, 0.1)] == [7]
    assert items.leaks("before it came nothing more", 0.6, 0.1) == []
