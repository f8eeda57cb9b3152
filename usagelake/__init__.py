"""Usage and cost analytics of coding-assistant logs as DataFrame functions."""
