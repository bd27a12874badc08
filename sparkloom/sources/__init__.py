"""Tables from files."""

from .loader import DataLoader, UnsupportedFormatError

__all__ = ["DataLoader", "UnsupportedFormatError"]
