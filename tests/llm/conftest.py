import pytest

from textmill.llm.shared import ship


@pytest.fixture(autouse=True)
def shipped():
    ship()


def components_of(ids, links):
    """Smallest id reachable from each id."""
    lead = {i: i for i in ids}
    while True:
        before = dict(lead)
        for a, b in links:
            lead[a] = lead[b] = min(lead[a], lead[b])
        if lead == before:
            return lead
