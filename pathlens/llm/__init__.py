"""Training-data operators: extraction, search, joins, scans, codecs, models and packing.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
