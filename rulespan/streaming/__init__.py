"""Programs whose inputs change: sessions, and streams that feed them."""
