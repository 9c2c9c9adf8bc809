"""kugiri: dictionary-driven text analytics as DataFrame operators."""
