"""feedelta: keyed snapshot diff of multi-table feeds, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"


def __getattr__(name):
    # Lazy, so that importing a leaf module does not pull in the whole API.
    if name in ("diff_feeds", "diff_tables"):
        from feedelta import api

        return getattr(api, name)
    raise AttributeError(name)
