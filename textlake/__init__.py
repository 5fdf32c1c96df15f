"""textlake: bulk text operations (search, packing, prompting, diffs) as Spark DataFrame plans."""

__version__ = "0.1.0"
