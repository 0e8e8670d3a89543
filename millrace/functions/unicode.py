"""What needs Unicode tables that the JVM functions don't offer: composing characters, and HTML entities."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")



def nfc(c: Column) -> Column:
    """Composed form."""
    return _nfc(c)


def nfkc(c: Column) -> Column:
    """Composed compatibility form."""
    return _nfkc(c)


def unescape(c: Column) -> Column:
    """HTML entities as their characters."""
    return _unescape(c)
