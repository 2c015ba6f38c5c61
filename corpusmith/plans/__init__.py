"""Query plans over the tables, grouped in registries."""

from __future__ import annotations


def registries():
    """All registries of the core, imported when asked for."""
    from corpusmith.plans.code import CODE
    from corpusmith.plans.engine import ENGINE
    from corpusmith.plans.feed import FEED
    from corpusmith.plans.logs import LOGS
    from corpusmith.plans.manifests import MANIFESTS
    from corpusmith.plans.search import SEARCH
    from corpusmith.plans.web import WEB

    return [FEED, CODE, ENGINE, SEARCH, MANIFESTS, LOGS, WEB]
