"""Opinion statistics as DataFrame operators."""
