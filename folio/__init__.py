"""folio: DataFrame operators over captured web pages, catalogs and long texts."""

__version__ = "0.1.0"
