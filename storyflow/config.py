"""Parameters of the jobs; the defaults are the published behaviour."""

from __future__ import annotations

from dataclasses import dataclass


# The defaults below.
@dataclass(frozen=True)
class StoryParams:
    """How two articles are scored and when they belong to one story."""

    diff_bonus: float = 0.1       # added when the sources differ
    same_penalty: float = 0.5     # taken off when they are the same
    keyword_bonus: float = 0.033  # added per shared keyword
    threshold: float = 0.9        # adjusted similarity of an edge
    min_samples: int = 2          # density, the article itself included

    @property
    def cross_need(self) -> float:
        """cosine + keyword bonus an edge between two sources needs."""
        return self.threshold - self.diff_bonus

    @property
    def same_need(self) -> float:
        """cosine + keyword bonus an edge inside one source needs."""
        return self.threshold + self.same_penalty


# The defaults below.
@dataclass(frozen=True)
class FreshParams:
    """Which stories are read in full and summarised."""

    min_weight: float = 0.8
    days: int = 2


@dataclass(frozen=True)
class SummaryParams:
    sentences: int = 3
    max_similarity: float = 0.7
    batch: int = 48               # ranked sentences folded per round, see summary.py


@dataclass(frozen=True)
class NearDupParams:
    min_ratio: float = 85.0
    drop_both_on_tie: bool = True
    block: int = 128              # texts per block of the verification grid


# Weight of each keyword signal.
SIGNAL_WEIGHTS = {"pos": 1.0, "ner": 2.0, "manual": 1.1}

# Entity labels that never become keywords.
EXCLUDED_ENTITY_LABELS = ("DATE", "ORDINAL", "CARDINAL", "MONEY", "TIME", "QUANTITY", "PERCENT")

# Topic lexicon, one phrase per entry.
LEXICON = (
    "israel", "palestine", "gaza", "russia", "ukraine", "china", "taiwan", "usa", "america", "iran", "india",
    "middle east", "north korea", "un", "eu", "border", "u.s.", "afghanistan", "iraq", "ai",
    "artificial intelligence", "machine learning", "cryptocurrency", "blockchain", "stocks", "economy", "recession",
    "inflation", "interest rates", "big tech", "startup", "ipo", "merger", "acquisition", "amazon", "google", "meta",
    "tesla", "election", "president", "congress", "senate", "supreme court", "legislation", "sanctions", "campaign",
    "investigation", "impeachment", "protest", "vote", "ballot", "governor", "government", "covid", "vaccine",
    "pandemic", "climate change", "global warming", "wildfire", "hurricane", "earthquake", "flood", "outbreak",
    "healthcare", "hospitals", "hamas", "terrorism", "cybersecurity", "hacking", "police", "shooting", "arrest",
    "fbi", "war", "conflict", "defense", "military", "secret service", "immigration", "celebrity", "tiktok",
    "twitter", "x", "sports", "olympics", "world cup", "movies", "hollywood", "netflix", "rally", "social media",
    "influencer", "musk", "trump", "harris", "biden", "pelosi", "obama",
)

# English function words left out of vectors; pass your own list to replace it.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "cannot", "could",
    "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have",
    "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is",
    "it", "its", "itself", "just", "me", "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on",
    "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own", "same", "she", "should", "so",
    "some", "such", "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they",
    "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when",
    "where", "which", "while", "who", "whom", "why", "will", "with", "would", "you", "your", "yours", "yourself",
    "yourselves",
)
