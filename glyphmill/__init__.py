"""glyphmill: localization-text analytics as Spark DataFrame operators."""
