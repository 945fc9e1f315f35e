"""The categories of questions."""

#: The categories of an evaluation set, and where a router may send a question.
CATEGORIES = ("ambiguous", "conditional", "multi-hop", "single-fact", "temporal", "unanswerable")
