"""Operators for preparing training corpora; nothing else in the library imports them."""

from tidegauge.llm.common import ORACLES, QUERIES  # noqa: F401
from tidegauge.llm import bpe, classifier, codes, exact_dedup, packing, pii, rules, simhash, suffixes, token_files, urls, warc, whitening  # noqa: F401
