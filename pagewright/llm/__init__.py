"""Operators that prepare document text for language-model training. Nothing outside this subpackage imports it."""
