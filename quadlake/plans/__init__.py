"""From syntax trees to lazy DataFrame plans."""
