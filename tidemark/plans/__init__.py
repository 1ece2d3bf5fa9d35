"""The compiler from syntax trees to DataFrame plans."""
