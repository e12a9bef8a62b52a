"""The query modules of this subpackage."""

from cisweave.llm import contamination, containers, moderation, percentiles, sampling

MODULES = [sampling, percentiles, containers, contamination, moderation]
