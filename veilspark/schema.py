"""Types, dimensions and options of the privacy engine."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (entity type, severity, disclosure cost, placeholder prefix, compared by digits, label).
ENTITIES = (
    ("PERSON", "medium", 2, "PERSON", False, "Name"),
    ("EMAIL", "medium", 3, "person", False, "Email address"),
    ("PHONE", "medium", 5, "PHONE", True, "Phone number"),
    ("ADDRESS", "high", 8, "ADDRESS", False, "Home address"),
    ("SSN", "high", 15, "SSN", True, "Social Security number"),
    ("CREDIT_CARD", "high", 15, "CARD", True, "Card number"),
    ("BANK", "high", 15, "BANK", True, "Bank account or routing number"),
    ("API_KEY", "high", 10, "API_KEY", False, "API key or secret"),
    ("PASSWORD", "high", 10, "PASSWORD", False, "Password"),
    ("IP_ADDRESS", "low", 1, "IP", False, "IP address"),
    ("DATE_OF_BIRTH", "medium", 5, "DOB", False, "Date of birth"),
    ("LOCATION", "low", 1, "PLACE", False, "Place"),
    ("ORGANIZATION", "low", 1, "ORG", False, "Organization"),
    ("USER_TERM", "high", 8, "TERM", False, "Your private word"),
)
TOPICS = (("HEALTH", "Health information"), ("FINANCE", "Financial information"), ("LEGAL", "Legal matter"))
WEIGHTS = {"high": 10, "medium": 5, "low": 2}
PRIORITIES = {"user_terms": 4, "rule": 3, "ner": 2, "dictionary": 1}
TOPIC_WEIGHT = 3
SITES = ("chatgpt", "claude", "gemini")
ACTIONS = ("renamed", "as_is", "allowlisted")
SOURCES = ("paste", "file", "typed")
# End of fixed values.

ENTITY_TYPES = tuple(e[0] for e in ENTITIES)
SEVERITY = {e[0]: e[1] for e in ENTITIES}
COST = {e[0]: e[2] for e in ENTITIES}
PREFIX = {e[0]: e[3] for e in ENTITIES}
NUMERIC = tuple(e[0] for e in ENTITIES if e[4])
LABEL = {e[0]: e[5] for e in ENTITIES} | dict(TOPICS)
DEFAULT_TYPES = tuple(t for t in ENTITY_TYPES if t != "ORGANIZATION")

MESSAGE = "seq bigint, provider string, conversation_id string, conversation_title string, conversation_url string, message_id string, role string, created_at timestamp, text string"
FINDING = "struct<type:string,start:int,end:int,value:string,severity:string,source:string,confidence:double>"
RESOLVED = "struct<id:string,type:string,value:string,key:string,start:int,end:int,severity:string,source:string,confidence:double,allowlisted:boolean>"


@dataclass(frozen=True)
class UserTerms:
    names: tuple[str, ...] = ()
    emails: tuple[str, ...] = ()
    phones: tuple[str, ...] = ()
    addresses: tuple[str, ...] = ()
    custom: tuple[str, ...] = ()


@dataclass(frozen=True)
class Options:
    """What detection looks for. The word lists, in lower case, are inputs that the caller gives, for instance by
    `word_list`: first names, common words, and stop words (words that are no names). None is built in."""

    terms: UserTerms = field(default_factory=UserTerms)
    allowlist: tuple[str, ...] = ()
    types: tuple[str, ...] = DEFAULT_TYPES
    first_names: frozenset[str] = frozenset()
    common_words: frozenset[str] = frozenset()
    stopwords: frozenset[str] = frozenset()

    @cached_property
    def known_names(self) -> frozenset[str]:
        """First names that are no common words."""
        return frozenset(n for n in self.first_names if len(n) >= 3) - self.common_words - self.stopwords


def word_list(spark: SparkSession, path: str, most: int = 1_000_000) -> frozenset[str]:
    """The distinct words of a text file of one or more words a line. A list of over `most` words is an error, as lists go
    to every task."""
    words = spark.read.text(path).select(F.explode(F.split(F.lower("value"), r"\s+")).alias("w")).where("w <> ''").distinct()
    found = frozenset(r["w"] for r in words.limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} words")
    return found


def entity_table(spark: SparkSession) -> DataFrame:
    """The dimension of entity types and topics."""
    rows = [(t, s, WEIGHTS[s], c, p, n, label) for t, s, c, p, n, label in ENTITIES] + [(t, None, TOPIC_WEIGHT, None, None, False, label) for t, label in TOPICS]
    return spark.createDataFrame(rows, "type string, severity string, weight int, cost int, prefix string, numeric boolean, label string")
