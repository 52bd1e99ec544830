"""Importing this module registers every query of this folder."""

from formline.llm import (decontaminate, embedding_dedup, language_id, line_dedup, minhash_dedup, packing, personal_data,  # noqa: F401
                           substring_dedup, token_counts, training_order, url_filter, vector_codes, whitening)
from formline.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
