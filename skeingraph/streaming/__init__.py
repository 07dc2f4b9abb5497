"""Empty on purpose: data are finite, versioned releases, and no operator has a stream, a watermark or state."""
