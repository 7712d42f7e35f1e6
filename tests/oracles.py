"""What tests compare with, made another way than the library makes it."""

import re
import unicodedata


def compared_name(x):
    """The words of a name without marks, in upper case and sorted."""
    bare = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", x or ""))
    return " ".join(sorted(re.findall("[A-Z0-9]+", bare.upper())))
