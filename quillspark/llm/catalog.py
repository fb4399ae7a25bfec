"""The registered queries of this subpackage: name -> (function of (spark, sf_dir), SQL or None)."""

from __future__ import annotations

from . import ann, bpe, chat_format, decontamination, language_id, license_scan, ngram_join, quality, substring_dedup, url_filter

MODULES = [decontamination, license_scan, language_id, bpe, ngram_join, substring_dedup, url_filter, chat_format, quality, ann]
QUERIES = {name: pair for m in MODULES for name, pair in m.QUERIES.items()}
