"""Plain versions of two rules, for the pipeline's test."""

from test_decontamination import brute as hits
from test_near_dedup import brute


def near_groups(rows):
    groups = {}
    for id, _, component, _ in brute(sorted(rows.items())):
        groups.setdefault(component, []).append(id)
    return list(groups.values())


def windows_hit(text, items):
    n, hit, _ = hits(text, list(enumerate(items)))
    return hit > 0 and 20 * hit >= n
