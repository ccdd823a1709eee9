"""Checks of settings, addresses, keys and statistics that come from outside."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_TYPES, ENTITY_TYPES, SITES, Options, UserTerms

# Fixed values.
HOSTS = {"chatgpt.com": "chatgpt", "claude.ai": "claude", "gemini.google.com": "gemini"}
SESSION_KEY = r"\A(?:map|approved):(chatgpt|claude|gemini):[^:]{1,200}\z"
COUNTS = ("prompts", "conversations", "findings", "shared", "protected", "score")
VERSION = 2
# End of fixed values.


def values_of(given: object) -> tuple[str, ...]:
    """The different strings of a list, trimmed and not empty, in order; none of anything else."""
    if not isinstance(given, (list, tuple)):
        return ()
    return tuple(dict.fromkeys(x.strip() for x in given if isinstance(x, str) and x.strip()))


def known_of(given: object, known: Iterable[str], otherwise: tuple[str, ...]) -> tuple[str, ...]:
    """Those of the known values that a list names, in the known order; the default if it is no list."""
    return tuple(k for k in known if k in given) if isinstance(given, (list, tuple)) else otherwise


def settings(value: object) -> tuple[Options, tuple[str, ...]]:
    """Options and sites of settings as they were stored (userTerms, allowlist, enabledTypes, sites); what is wrong is left out."""
    v = value if isinstance(value, Mapping) else {}
    given = v.get("userTerms")
    terms = given if isinstance(given, Mapping) else {}
    user = UserTerms(**{f: values_of(terms.get(f)) for f in ("names", "emails", "phones", "addresses", "custom")})
    return Options(terms=user, allowlist=values_of(v.get("allowlist")), types=known_of(v.get("enabledTypes"), ENTITY_TYPES, DEFAULT_TYPES)), known_of(v.get("sites"), SITES, SITES)


def site_of(url: Column) -> Column:
    """The site of an https address by its exact host; null for any other."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    found = F.element_at(F.create_map(*[F.lit(x) for pair in HOSTS.items() for x in pair]), host)
    return F.when(F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("")) == "https", found)


def session_key_error(key: Column, url: Column) -> Column:
    """Null for a session key of the right shape and of the site that the address belongs to, else what is wrong."""
    site = F.coalesce(site_of(url), F.lit("chatgpt"))
    named = F.regexp_extract(key, SESSION_KEY, 1)
    return F.when(F.coalesce(named, F.lit("")) == "", "invalid session key").when(named != site, "wrong site")


def valid_stats(stats: Column) -> Column:
    """Whether a struct of live statistics (version, since, cost, COUNTS, categories) is one that may be shown."""
    number = lambda c: F.coalesce(~F.isnan(c.cast("double")) & (c.cast("double") >= 0) & (c.cast("double") < float("inf")), F.lit(False))
    good = F.coalesce(stats["version"] == VERSION, F.lit(False))
    for name in ("since", "cost"):
        good = good & (stats[name].isNull() | number(stats[name]))
    for name in COUNTS:
        good = good & number(stats[name])
    return good & (stats["score"] <= 100) & F.coalesce(F.forall(stats["categories"], lambda c: F.coalesce(c.rlike(r"\A[A-Z_]{1,40}\z"), F.lit(False))), F.lit(False))
