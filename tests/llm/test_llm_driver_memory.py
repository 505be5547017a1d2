"""Memory of the driver after a fit or a plan of many tables."""

import weakref

from trajecta.llm import common, language_id, near_dedup, toxicity


def test_what_only_cycles_hold_goes_and_memory_is_given_back(monkeypatch):
    class Held:
        pass

    given, seen = [], []
    monkeypatch.setattr(common, "give_back", lambda: given.append(seen[0]() is None))

    @common.frugal_on_driver
    def fit(n):
        held = Held()
        held.own = held
        seen.append(weakref.ref(held))
        return n + 1

    assert fit(1) == 2
    assert given == [True]


def test_fits_and_near_duplicates_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    for run in (language_id.train, toxicity.train, near_dedup.near_duplicates):
        try:
            run(None, None)
        except (AttributeError, TypeError):
            pass
    assert len(given) == 3
